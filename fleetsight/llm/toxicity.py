"""Toxicity by a counterfactually regularised linear classifier over words and word beginnings.

In labelled sentences identity terms are swapped with others of their group. A neutral mention should
score the same whichever group it names, so the fit adds the squared change of score under each swap
to the logistic loss. What a group's name gained from standing in toxic sentences is thereby taken
from it and left to the words that make them toxic.

The fit sees a bounded sample of labelled documents (``SAMPLE``, by hash of the id). Spark counts the
features of the sample and keeps the most telling ones (``FEATURES``), so what reaches the driver is
bounded too: the features, and for each sampled document which of them it has. Scoring covers all
documents in one pass without a shuffle; the model in its closure has a fixed size.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import stored
from fleetsight.llm.vocab import Memory

#: Labelled documents that the fit sees at most. A parameter, and the bound of what is broadcast.
SAMPLE = 16_000
#: Features of the model at most, and documents that must have one.
FEATURES = 4_000
LEAST_DOCS = 4
#: Words begin alike where a language derives them, so beginnings of these lengths are features.
BEGINNINGS = (4, 5, 6)
#: Weight of the penalty on score changes, and of the ridge.
PENALTY = 10.0
RIDGE = 2e-4
PASS_AT = 0.7
#: Terms that may be swapped within their group. A parameter.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "femme", "homme", "frau", "mann", "mujer", "hombre"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants", "citizens"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
)
_BUCKETS = 1 << 20
_ROWS = 256
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [f"={word}", *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def _distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield list(zip(*[c.to_pylist() for c in batch.slice(at, _ROWS).columns]))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _texts(batches):
        labels, found = [], []
        for text, label in rows:
            own = {f for w in _distinct_words(text) for f in features_of(w)}
            found += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], names=["feature", "label"])


def _vector(index: dict[str, int], words: Iterable[str]) -> dict[int, int]:
    """How many distinct words have each feature of the model."""
    out: dict[int, int] = {}
    for w in words:
        for f in features_of(w):
            at = index.get(f)
            if at is not None:
                out[at] = out.get(at, 0) + 1
    return out


def _swaps(index: dict[str, int], partners: dict[str, str], text: str) -> list[dict[int, int]]:
    """Feature changes of sentences when their identity terms are swapped."""
    changes = []
    for sentence in _SENTENCE.split((text or "").lower()):
        named = [w for w in dict.fromkeys(_WORD.findall(sentence)) if w in partners]
        if named:
            change = _vector(index, [partners[w] for w in named])
            for at, n in _vector(index, named).items():
                change[at] = change.get(at, 0) - n
            if change := {at: n for at, n in change.items() if n}:
                changes.append(change)
    return changes


def _sampled(index: dict[str, int], partners: dict[str, str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (swap 0), and one per sentence that a swap changes (swap 1)."""
    for rows in _texts(batches):
        out = []
        for text, label in rows:
            vectors = [(0, _vector(index, _distinct_words(text))), *[(1, c) for c in _swaps(index, partners, text)]]
            out += [(swap, label, list(v), list(v.values())) for swap, v in vectors]
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32()))],
            names=["swap", "label", "at", "n"],
        )


class _Rows:
    """Sparse rows as flat arrays."""

    def __init__(self, rows: Sequence[tuple[list[int], list[int]]], width: int):
        self.size, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows]) if rows else np.zeros(0, int)
        self.at = np.array([i for a, _ in rows for i in a], dtype=np.int64)
        self.n = np.array([v for _, b in rows for v in b], dtype=float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.n * w[self.at], self.size) if self.size else np.zeros(0)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.n * r[self.row], self.width) if self.size else np.zeros(self.width)


def fit_weights(
    rows: Sequence[tuple[list[int], list[int]]], labels: np.ndarray, swaps: Sequence[tuple[list[int], list[int]]], width: int,
    penalty: float = PENALTY, steps: int = 600,
) -> tuple[np.ndarray, float]:
    """Minimises logistic loss + ridge + penalty * mean squared change under swaps, by Adam steps.

    The rarer label counts more, by the root of the labels' ratio.
    """
    x, c = _Rows(rows, width), _Rows(swaps, width)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    pos = max(1.0, labels.sum())
    each = np.where(labels > 0, np.sqrt(max(1.0, len(labels) - pos) / pos), 1.0)
    each = each / max(1e-9, each.sum())
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -40, 40)))
        error = (p - labels) * each
        g = np.append(x.back(error) + RIDGE * w, error.sum())
        if c.size:
            g[:-1] += 2 * penalty * c.back(c.times(w)) / c.size
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, penalty: float = PENALTY,
    groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias, from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    Other labels and null ids are left out; repeated ids count once. Without both labels there are no weights.
    """
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    )
    share = min(1.0, 0.95 * sample / max(1, clean.count()))
    chosen = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)) < int(share * _BUCKETS)).limit(sample)
    texts = stored(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(F.broadcast(chosen), "doc_id").select("text", "label")  # at most ``sample`` pairs of numbers
    )
    totals = {r.label: r.n for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return {}, 0.0
    pos, neg = float(totals[1]), float(totals[0])
    counts = texts.mapInArrow(_counted, "feature string, label int").groupBy("feature").agg(
        F.sum("label").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n")
    )
    # How unevenly a feature is spread over the labels: the likelihood ratio against an even spread.
    expected = F.col("n") * pos / (pos + neg)

    def part(seen, due):
        return F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)

    telling = 2 * (part(F.col("a"), expected) + part(F.col("n") - F.col("a"), F.col("n") - expected))
    best = (
        counts.where(F.col("n") >= LEAST_DOCS).select("feature", telling.alias("g")).where("g > 7")
        .orderBy(F.desc("g"), "feature").limit(features)
    )
    index = {r.feature: i for i, r in enumerate(best.collect())}  # at most ``features``
    partners = {w: group[(i + 1) % len(group)] for group in groups for i, w in enumerate(group)}
    rows = texts.mapInArrow(functools.partial(_sampled, index, partners), "swap int, label int, at array<int>, n array<int>").collect()
    own, swaps = [r for r in rows if not r.swap], [(r["at"], r.n) for r in rows if r.swap]
    w, b = fit_weights([(r["at"], r.n) for r in own], np.array([r.label for r in own], float), swaps, len(index), penalty)
    return {f: float(w[i]) for f, i in index.items()}, b


def _scored(weights: dict[str, float], bias: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worth = Memory(lambda word: sum(weights.get(f, 0.0) for f in features_of(word)))
    for rows in _texts(batches):
        raw = np.array([bias + sum(map(worth.__getitem__, sorted(_distinct_words(text)))) for _, text in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in rows], pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(raw, -40, 40))))], names=["doc_id", "score"]
        )


def score_toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs`` (doc_id, text), fitted on ``labels`` (doc_id, label).

    Null texts count as empty; an empty text scores the bias alone. Repeated rows and null ids get a
    row each. An empty table gives no rows. Only doc_id and text are read.
    """
    weights, bias = fit_toxicity(docs, labels, **settings)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        functools.partial(_scored, weights, bias), "doc_id long, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= PASS_AT).cast("int"))
