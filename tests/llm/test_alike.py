"""Near copies of the pipeline against brute-force Jaccard similarities."""

import random

import corpus_pipeline
import numpy as np
import pytest
from augury.llm import simhash
from augury.llm.common import materialise
from pyspark.sql import functions as F


def brute_kept(texts, width=5, alike=0.8):
    """Smallest id of each component of (id -> text) that Jaccard similarities of word shingles link."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else {()}

    ids, root = sorted(texts), {i: i for i in texts}
    sets = {i: shingles(texts[i]) for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and common / (len(sets[i]) + len(sets[j]) - common) >= alike:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def planted():
    """Texts of 44 to 404 words, each with copies whose similarity lies between 0.6 and 0.95, and a few very short ones."""
    draw, texts = random.Random(3), {}
    for n in (44, 104, 204, 404):
        for k in range(12):
            words = [f"w{draw.randrange(10**6)}" for _ in range(n)]
            texts[len(texts)] = " ".join(words)
            for share in (0.95, 0.81, 0.79, 0.72, 0.65, 0.6):  # the last part is replaced: shared shingles over all
                same = round((n - 4) * 2 * share / (1 + share)) + 4
                texts[len(texts)] = " ".join(words[:same] + [f"x{draw.randrange(10**6)}" for _ in range(n - same)])
    texts[len(texts)] = "a b c d e f g h i"
    texts[len(texts)] = "a b c d e f g h"
    texts[len(texts)] = "A b c d\te f g h i"
    texts[len(texts)] = "one line again and again\n" * 3
    texts[len(texts)] = "one line again and again\n" * 50
    return texts


@pytest.mark.parametrize("options", [{}, {"part": (7, 2_000_000)}])
def test_copies_are_verified(spark, options):
    texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_alike(docs, **simhash.SHARED, **options).collect()}
    assert kept == brute_kept(texts)


def test_stage_equals_brute_force(spark):
    docs = materialise(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "test")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == brute_kept(texts)


def test_rows_without_id_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (8, "")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one_alike(docs, **simhash.SHARED).collect()) == ["5", "7", "None", "None"]


def test_links_between_parts():
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(7, dtype=np.uint64)]
    fps = np.zeros((3, 4), np.uint64)
    every = np.arange(3)
    child, root = simhash.alike_links(sets, fps, every, every, 76, 0.8)
    assert list(zip(child, root, strict=True)) == [(1, 0)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.keep_one_alike(docs, **simhash.SHARED).count() == 0


def edited(draw, words, share):
    """A copy with ``share`` of its words, one at least, replaced, dropped or doubled."""
    out = list(words)
    for place in sorted(draw.sample(range(len(out)), max(1, round(share * len(out)))), reverse=True):
        out[place : place + 1] = draw.choice([["edit"], [], [out[place]] * 2])
    return out


def test_recall_of_word_edits(spark):
    """Copies with 1, 2 and 5 % of their words edited: what lies at 0.8 or more is found, nothing else."""
    draw, texts, share_of = random.Random(11), {}, {}
    for share in (0.01, 0.02, 0.05):
        for _ in range(100):
            words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(100, 400))]
            texts[len(texts)] = " ".join(words)
            share_of[len(texts)] = share
            texts[len(texts)] = " ".join(edited(draw, words, share))
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_alike(docs, **simhash.SHARED).collect()}
    assert kept == brute_kept(texts)
    recall = {s: sum(i not in kept for i, x in share_of.items() if x == s) / 100 for s in (0.01, 0.02, 0.05)}
    print(recall)
    assert recall[0.01] == 1 and recall[0.02] >= 0.5


@pytest.mark.parametrize("words, radius", [(1, 4), (4, 76), (4, 100)])
def test_near_pairs_in_pieces_are_all_of_them(monkeypatch, words, radius):
    draw = np.random.default_rng(words)
    a, b = (draw.integers(0, 2**64, (n, words), dtype=np.uint64) for n in (70, 333))
    b[:50] = a[:50] ^ np.uint64(5)
    b[60] = ~a[60]  # all bits differ
    want = set(zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None]).sum(2, dtype=int) <= radius), strict=True))
    for piece in (simhash.PIECE, (64, 16), (1000, 333)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        got = list(zip(*simhash._near(a, b, radius), strict=True))
        assert set(got) == want and len(got) == len(want) >= 50
    assert len(simhash._near(a[:0], b, radius)[0]) == len(simhash._near(a, b[:0], radius)[0]) == 0


def test_only_fingerprints_of_like_sizes_are_compared(spark):
    # All sizes that can just be alike, 4 to 5, are within the reach of each other.
    sizes = spark.range(1, 300_000).select(simhash.size_band(4 * F.col("id"), 0.8).alias("low"), simhash.size_band(5 * F.col("id"), 0.8).alias("high"))
    assert sizes.where(F.col("high") - F.col("low") > simhash.SIZES[0]).count() == 0
    fps = [(f"{k:064x}", band) for k, band in ((0, 0), (1, 2), (2, 5), (3, 9), (3, 5))]
    for group in (None, 1):
        got = simhash.link_forest(spark.createDataFrame(fps, "fp string, band int"), 76, group, 256, 2).collect()
        assert {frozenset((int(r["u"], 16), int(r["v"], 16))) for r in got} - {frozenset({3})} == {frozenset({0, 1}), frozenset({2, 3})}
        assert len(simhash.link_forest(spark.createDataFrame(fps, "fp string, band int").select("fp").distinct(), 76, group, 256).collect()) >= 3
    assert simhash.link_forest(spark.createDataFrame([], "fp string, band int"), 76, None, 256, 2).count() == 0
