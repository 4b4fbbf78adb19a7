"""Document quality by Bradley-Terry pairwise ranking.

Every document has a vector of surface features.  Preference pairs (a good and a bad labelled document) are learned by
logistic loss on feature differences, without an intercept; the learned weights give each document a worth.  The score is the
worth passed through a logistic curve that is 0.3 at the quantile of labelled worths at which the share of bad documents lies.

Defined results: a null text counts as empty, and an empty text gets the features of no characters; very long texts are
measured whole; repeated rows get equal scores; without both labels every score is 0.5.  Labels of one doc_id that disagree
count as bad; null labels and null ids are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import ids_and_texts, remainder, sample_per_class, slices

DOCS_PER_CLASS = 2500  # bound on the labelled rows that are learned from, in each class
PAIRS_PER_DOC = 4  # preference pairs that each document of the larger sampled class enters

# Classes of bytes whose successions are counted.
_CLASS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate((b" \t\r\v\f", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"()-", b"#*$%&|<>@^~_=+/\\{}[]`")):
    _CLASS[list(_chars)] = _k
N_CLASS = 10
N_FEATURES = N_CLASS * N_CLASS + 7


def features(text: str | None) -> np.ndarray:
    """Shares of the successions of byte classes (square roots, to weigh rare ones) and measures of words and lines."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) > 1:
        kind = _CLASS[np.frombuffer(raw, np.uint8)]
        out[: N_CLASS * N_CLASS] = np.sqrt(np.bincount(kind[:-1] * N_CLASS + kind[1:], minlength=N_CLASS * N_CLASS) / (len(raw) - 1))
    words = raw.split()
    n = len(words)
    if n:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[-7:] = (np.log1p(n), np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), len(set(words)) / n, np.log(sum(map(len, words)) / n), np.sqrt(1 - len(set(lines)) / len(lines)), np.log1p(n / len(lines)), 1.0)
    return out


def fit_pairs(diff: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on (preferred - other) rows by Newton's method with a ridge."""
    weight = np.zeros(diff.shape[1])
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(np.clip(diff @ weight, -30, 30)))
        grad = ridge * weight - diff.T @ miss / len(diff)
        hess = (diff * (miss * (1 - miss) / len(diff))[:, None]).T @ diff + ridge * np.eye(len(weight))
        step = np.linalg.solve(hess, grad)
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    return weight


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for piece in slices(batches):
        yield pd.DataFrame({"doc_id": piece["doc_id"], "quality": piece["quality"], "x": [features(t) for t in piece["text"]]})


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, pairs_per_doc: int = PAIRS_PER_DOC) -> tuple[np.ndarray, float, float] | None:
    """Weights, the worth at the threshold quantile and the spread of worths; None if a class is missing.

    About ``docs_per_class`` labelled documents of each class are used, so pairs and features on the driver are bounded.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share_bad = marks.agg(F.avg(1 - F.col("quality"))).first()[0]
    chosen = sample_per_class(marks, "quality", F.col("doc_id"), docs_per_class)
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    # The sample has about 2 x docs_per_class short rows: its size is bounded by that parameter.
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_feature_rows, "doc_id string, quality int, x array<double>")
    seen = rows.toPandas()
    # The order of rows, which pairs are drawn by, depends on ids and features alone.
    seen = seen.assign(sign=[hash(tuple(x)) for x in seen["x"]]).sort_values(["doc_id", "sign"], kind="stable")
    x, good = np.array(seen["x"].tolist(), float).reshape(-1, N_FEATURES), seen["quality"].to_numpy() == 1
    if not good.any() or good.all():
        return None
    rng = np.random.default_rng(10)
    n = pairs_per_doc * max(good.sum(), (~good).sum())
    better, worse = np.flatnonzero(good)[rng.integers(0, good.sum(), n)], np.flatnonzero(~good)[rng.integers(0, (~good).sum(), n)]
    scale = x.std(0)
    diff = (x[better] - x[worse]) / np.where(scale > 1e-9, scale, np.inf)
    weight = fit_pairs(diff) / np.where(scale > 1e-9, scale, np.inf)
    worth = x @ weight
    # Worths weighed so that bad ones have their share of all labels, not of the sample.
    mass = np.where(good, (1 - share_bad) / good.sum(), share_bad / (~good).sum())
    order = np.argsort(worth)
    at = np.searchsorted(np.cumsum(mass[order]), share_bad)
    low, high = worth[order[max(0, at - 1)]], worth[order[min(len(order) - 1, at)]]
    return weight, float(low + high) / 2, float(max(1e-6, np.std(worth) / 4))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, worth, score and predicted of every row; map-only."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("worth"), F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    weight, middle, spread = model
    base = float(np.log(threshold / (1 - threshold)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            worth = np.array([features(t) for t in piece["text"]], float).reshape(-1, N_FEATURES) @ weight
            value = 1 / (1 + np.exp(-np.clip((worth - middle) / spread + base, -30, 30)))
            yield pd.DataFrame({"doc_id": piece["doc_id"], "worth": worth, "score": value, "predicted": (value >= threshold).astype("int32")})

    return ids_and_texts(docs).mapInPandas(score, "doc_id string, worth double, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast(kind))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Score all rows of ``docs``; labels of rows whose crc32 remainder is ``held_out`` are never learned from."""
    part = remainder(F.col("doc_id"), folds)
    model = train(docs.where(part != held_out), labels.where(part != held_out))
    return score_quality(docs, model).select("doc_id", (part == held_out).alias("held_out"), "score", "predicted", "worth")
