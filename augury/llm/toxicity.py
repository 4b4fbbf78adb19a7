"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, give each word a probability.  A model's own counts are those of its class
(the texts that have the word), less absolute discounts for words counted once, twice or more often; the discounted mass goes to
continuation counts (after how many different words a word occurs), which both classes share, and these leave some to any other
word.  A rare expression thus has the shared probability in both models and says little, and a new one nothing but the ratio of
what the classes leave to the backoff.  A word counts once in a text: one that repeats itself is one observation.

The evidence of a text is the difference of its log-likelihoods under the two models, normalised by length: the mean a word over
the whole text, and over its ``BEST`` most telling different words, as a few words make a long text toxic.  A logistic curve over
both, fitted on the evidence of labelled texts under models that have no counts of theirs, turns them into a score.

Defined results: a null, empty or letterless text has evidence 0 and the score that the curve has there; very long texts are
scored whole; repeated rows get equal scores; without both labels in the training rows every score is 0.  Labels of one doc_id
that disagree count as toxic; null labels and null ids are not learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import ids_and_texts, letter_runs, materialise, remainder, sample_per_class, slices

BEST = 2  # most telling words of a text
DOCS_PER_CLASS = 2500  # bound on the labelled rows that are learned from, in each class
PARTS = 8  # of the sample
START = "^"  # stands before the first word of a text


def discounts(counts: Iterable[int]) -> tuple[float, float, float]:
    """Absolute discounts of words counted once, twice and more often, from how many there are of each."""
    n1, n2, n3, n4 = (float(x) for x in np.bincount(np.minimum([*counts, 0], 5), minlength=6)[1:5])
    share = n1 / max(1.0, n1 + 2 * n2)
    found = 1 - 2 * share * n2 / max(1.0, n1), 2 - 3 * share * n3 / max(1.0, n2), 3 - 4 * share * n4 / max(1.0, n3)
    return tuple(min(max(x, 0.1), k - 0.05) for k, x in enumerate(found, 1))


class _Level:
    """Absolute discounts of counts; ``left`` is the share that they leave to the backoff."""

    def __init__(self, counts: np.ndarray):
        self.total, self.less = int(counts.sum()), np.array([0.0, *discounts(counts[counts > 0])])
        self.left = float(self.less[np.minimum(counts, 3)].sum()) / self.total

    def chance(self, n: np.ndarray, backoff: np.ndarray) -> np.ndarray:
        return (n - self.less[np.minimum(n, 3)]) / self.total + self.left * backoff


class Levels:
    """The counts of both classes and the contexts that they share, a place for each word."""

    def __init__(self, counts: tuple[np.ndarray, np.ndarray], contexts: np.ndarray):
        self.classes, self.shared = [_Level(c) for c in counts], _Level(contexts)
        self.words = len(contexts) + 1  # all words seen, and one place for any other

    def chance(self, k: int, n: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return self.classes[k].chance(n, self.shared.chance(contexts, 1 / self.words))


class KneserNey:
    """Both classes' models: ``chance(k, word)`` is the probability of a word in class ``k``."""

    def __init__(self, counts: tuple[dict[str, int], dict[str, int]], contexts: dict[str, int]):
        self.counts, self.contexts = counts, contexts
        self.levels = Levels(tuple(np.array([*c.values()], np.int64) for c in counts), np.array([*contexts.values()], np.int64))

    def chance(self, k: int, word: str) -> float:
        return float(self.levels.chance(k, np.array(self.counts[k].get(word, 0)), np.array(self.contexts.get(word, 0))))


class Ratios:
    """log P(toxic) - log P(ordinary) by word: 16 bytes for each seen word, which its XXH64 names, and ``other`` for any other."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: float):
        order = np.argsort(keys)
        self.keys, self.values, self.other = keys[order], values[order], other

    def of(self, words: list[str]) -> np.ndarray:
        keys = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.other)

    def __getitem__(self, word: str) -> float:
        return float(self.of([word])[0])


@dataclass
class Model:
    """Ratios of words, and the curve over both kinds of evidence."""

    ratio: Ratios
    slopes: tuple[float, float] = (1.0, 0.0)
    base: float = -1.0

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(found @ np.array(self.slopes) + self.base, -30, 30)))


def count_words(labelled: DataFrame) -> DataFrame:
    """word, t and o (texts of each class that have it) and contexts (different words before it) of (toxic, text) rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            words: dict[bool, Counter] = {True: Counter(), False: Counter()}
            pairs: set[tuple[str, str]] = set()
            for toxic, text in zip(piece["toxic"], piece["text"], strict=True):
                found = letter_runs(text)
                words[bool(toxic)].update(set(found))
                pairs.update(zip(found, [START, *found], strict=False))
            rows = [(w, None, words[True][w], words[False][w]) for w in {*words[True], *words[False]}] + [(w, before, 0, 0) for w, before in pairs]
            yield pd.DataFrame(rows, columns=["word", "before", "t", "o"])

    each = labelled.mapInPandas(count, "word string, before string, t long, o long").groupBy("word", "before").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    return each.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("before").alias("contexts"))


def fit_models(counts: DataFrame) -> Model | None:
    """Both models from the counts of a bounded sample; None if a class has no word."""
    table = counts.select(F.xxhash64("word").alias("key"), "t", "o", "contexts").toArrow()
    key, t, o, contexts = (table[c].to_numpy() for c in ("key", "t", "o", "contexts"))
    if not (t.any() and o.any()):
        return None
    levels = Levels((t, o), contexts)
    toxic, plain = levels.classes
    return Model(Ratios(key, np.log(levels.chance(0, t, contexts) / levels.chance(1, o, contexts)), math.log(toxic.left / plain.left)))


def evidence(model: Model, text: str | None) -> tuple[float, float]:
    """The mean log-likelihood ratio a word over the most telling words of the text, and over the whole text."""
    words = [w for w, _ in groupby(letter_runs(text))]  # a word said again at once is said once
    if not words:
        return 0.0, 0.0
    times = Counter(words)
    ratio = model.ratio.of([*times])
    return float(np.sort(ratio)[-BEST:].mean()), float(ratio @ np.array([*times.values()], float)) / len(words)


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[tuple[float, float], float]:
    """Slopes and base of a ridge logistic curve by Newton's method, classes weighed so that ``share`` of the rows are of class 1."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    design, beta, ridge = np.column_stack([(x - middle) / spread, np.ones(len(x))]), np.zeros(3), 1e-2 * np.eye(3)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (p - y)) + ridge @ beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[:2] / spread
    return tuple(slopes.tolist()), float(beta[2] - slopes @ middle)


def _measured(texts: pd.Series, model: Model) -> np.ndarray:
    return np.array([evidence(model, t) for t in texts], float).reshape(-1, 2)


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> Model | None:
    """Models and curve from about ``docs_per_class`` labelled texts of each class; None if a class is missing.

    The curve is fitted on the evidence that each sampled text has under models of the other parts of the sample, of which there
    are ``PARTS``; the counts that are used are those of the whole sample.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg("toxic")).first()[0]
    chosen = sample_per_class(marks, "toxic", F.col("doc_id"), docs_per_class)
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    # The sample has about 2 x docs_per_class short rows: its size is bounded by that parameter.
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(PARTS)))
    rows = materialise(rows.select("part", "toxic", "text"), "toxic-sample")
    model = fit_models(count_words(rows.select("toxic", "text")))
    if model is None:
        return None
    others = [fit_models(count_words(rows.where(F.col("part") != k).select("toxic", "text"))) for k in range(PARTS)]
    shared = docs.sparkSession.sparkContext.broadcast(others)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            models = [shared.value[k] or model for k in piece["part"]]
            found = np.array([evidence(m, t) for m, t in zip(models, piece["text"], strict=True)], float).reshape(-1, 2)
            yield pd.DataFrame({"toxic": piece["toxic"], "best": found[:, 0], "mean": found[:, 1]})

    held = rows.mapInPandas(measure, "toxic int, best double, mean double").toPandas()
    y = held["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        model.slopes, model.base = _logistic(held[["best", "mean"]].to_numpy(float), y, float(share))
    return model


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, evidence (most telling words), mean_evidence (whole text), score and predicted of every row; map-only."""
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("evidence"), F.lit(0.0).alias("mean_evidence"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for piece in slices(batches):
            found = _measured(piece["text"], model)
            value = model.score(found)
            yield pd.DataFrame({"doc_id": piece["doc_id"], "evidence": found[:, 0], "mean_evidence": found[:, 1], "score": value, "predicted": (value >= 0.5).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ids_and_texts(docs).mapInPandas(score, "doc_id string, evidence double, mean_evidence double, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast(kind))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Score all rows of ``docs``; labels of rows whose crc32 remainder is ``held_out`` are never learned from."""
    part = remainder(F.col("doc_id"), folds)
    model = train(docs.where(part != held_out), labels.where(part != held_out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (part == held_out).alias("held_out"), "score", "predicted", "evidence", "mean_evidence")
