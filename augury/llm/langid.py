"""Language identification by hierarchical discrimination.

A multinomial model predicts the language family; within a family, one linear support vector machine for each pair of its
languages votes.  Both see shares of byte 1- to 3-grams of the lower-case letters, hashed to a fixed number of columns.

Defined results: null texts and texts without a letter get ``und`` and score 0, as does everything if nothing can be learned;
a family of one language needs no vote; ties of votes go to the larger sum of margins, then to the smaller name; very long
texts are measured whole; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import ids_and_texts, remainder, sample_per_class, slices

DOCS_PER_LANG = 800  # bound on the labelled rows that are learned from, in each language
N_FEATURES = 2048
LEAST = 0.4  # score that a text needs to count as written in a learned language

# Families of common languages by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu",
    "semitic": "ar he",
}
_family = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_not_letters = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return _family.get(lang, lang)


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams; each word has a space before and after it."""
    raw = np.frombuffer((" " + _not_letters.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    out = np.bincount(raw % 256, minlength=N_FEATURES).astype(float)
    for key in (a * 257 + b, (a * 257 + b) * 257 + c):
        out += np.bincount(256 + (key * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(N_FEATURES - 256), minlength=N_FEATURES)
    return np.sqrt(out / max(1.0, out.sum()))


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for piece in slices(batches):
        yield pd.DataFrame({"lang": piece["lang"], "x": [features(t) for t in piece["text"]]})


def _letters(text: str = "text"):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> dict | None:
    """Family model and pair machines from about ``docs_per_lang`` texts of each non-null ``lang``; None without any."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.col("lang") != "und") & _letters())
    x = sample_per_class(rows, "lang", F.coalesce(F.col("doc_id").cast("string"), F.col("text")), docs_per_lang)
    # The sampled features (bounded by docs_per_lang) are fitted several times.
    x = x.select("lang", "text").mapInPandas(_feature_rows, "lang string, x array<double>").select("lang", array_to_vector("x").alias("features")).persist()
    langs = sorted(r["lang"] for r in x.select("lang").distinct().collect())
    if not langs:
        x.unpersist()
        return None
    families = sorted({family_of(lang) for lang in langs})
    number = lambda names: F.element_at(F.create_map(*[y for lang in langs for y in (F.lit(lang), F.lit(float(names.index(family_of(lang) if names is families else lang))))]), F.col("lang"))
    model: dict = {"langs": langs, "families": families, "pairs": {}}
    if len(families) > 1:
        fit = LogisticRegression(family="multinomial", regParam=1e-4, standardization=False, maxIter=40).fit(x.select("features", number(families).alias("label")))
        model["family"] = (fit.coefficientMatrix.toArray(), fit.interceptVector.toArray())
    for family in families:
        for a, b in combinations([lang for lang in langs if family_of(lang) == family], 2):
            fit = LinearSVC(regParam=1e-4, standardization=False, maxIter=30).fit(x.where(F.col("lang").isin(a, b)).select("features", (F.col("lang") == b).cast("double").alias("label")))
            model["pairs"][a, b] = (fit.coefficients.toArray(), float(fit.intercept))
    x.unpersist()
    return model


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each row of features: the family's probability times the weakest winning vote's."""
    families, n = model["families"], len(x)
    p = np.ones((n, 1))
    if len(families) > 1:
        weight, base = model["family"]
        z = x @ weight.T + base
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    family, found, score = p.argmax(1), np.empty(n, object), p.max(1)
    for k, name in enumerate(families):
        rows = np.flatnonzero(family == k)
        langs = [lang for lang in model["langs"] if family_of(lang) == name]
        found[rows] = langs[0]
        if len(langs) < 2 or not len(rows):
            continue
        votes, total, margin = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
        for i, j in combinations(range(len(langs)), 2):
            weight, base = model["pairs"][langs[i], langs[j]]
            m = x[rows] @ weight + base
            for lang, signed in ((i, -m), (j, m)):
                votes[:, lang] += signed > 0
                total[:, lang] += signed
                margin[:, lang] = np.minimum(margin[:, lang], signed)
        # Most votes, then the larger sum of margins; the first of equals has the smaller name.
        best = np.where(votes == votes.max(1, keepdims=True), total, -np.inf).argmax(1)
        found[rows] = np.array(langs, object)[best]
        score[rows] = score[rows] / (1 + np.exp(-np.clip(2 * margin[np.arange(len(rows)), best], -30, 30)))
    return found.tolist(), score


def predict_texts(model: dict, texts, letters) -> tuple[list[str], np.ndarray]:
    """``predict`` of texts; ``und`` and 0 for those without a letter.  Features are held for a bounded number of texts."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    known = np.flatnonzero(np.asarray(letters, bool))
    texts = list(texts)
    for m in range(0, len(known), 512):
        rows = known[m : m + 512]
        found, score = predict(model, np.array([features(texts[i]) for i in rows]))
        scores[rows] = score
        for i, lang in zip(rows, found, strict=True):
            langs[i] = lang
    return langs, scores


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` needed to know a row (doc_id) with lang_pred and score; map-only."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            langs, scores = predict_texts(shared.value, piece["text"], piece["ok"])
            yield pd.DataFrame({"doc_id": piece["doc_id"], "lang_pred": langs, "score": scores})

    return ids_and_texts(docs).withColumn("ok", _letters()).mapInPandas(label, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Predict all rows of ``docs``; rows whose crc32 remainder is ``held_out`` are never learned from."""
    part = remainder(F.col("doc_id"), folds)
    model = train(docs.where(part != held_out))
    return identify(docs, model).select("doc_id", (part == held_out).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: dict | None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is in a learned language with a score of ``least`` or more."""
    if model is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def sure(texts: pd.Series, letters: pd.Series) -> pd.Series:
        return pd.Series(predict_texts(shared.value, texts, letters)[1] >= least, dtype=bool)

    return docs.where(sure(F.col("text"), _letters()))
