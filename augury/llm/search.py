"""Ranked lexical search by pipelined term partitioning.

Documents are read once and cut, where they are read, into shards; of each shard and each term of the items there is one packed
posting row.  Terms are dealt to ``OWNERS`` by the share of documents that hold them, rare ones first.  Items travel in bundles:
for each shard, a bundle's sparse accumulators (item, document, score so far) go through the owners in their order, each a cogroup
of accumulators and the owner's postings that adds whole-number contributions.  The last owner, that of the common terms, picks
the best of the shard at once, so dense accumulators are never moved.

Between owners an accumulator stays only if its score, with all that later owners could add at most, reaches the ``TOP``-th best
score of its item in the shard so far.  What goes could not have come among the best of its shard, so the result is exact: later
postings may bring it back, with a score that is too low to matter.

Terms of no weight (those in nearly every document) add nothing and are not looked up.  A bit map of the items' terms, of a fixed
most size, thins the words of a text; the join with the terms themselves decides.

Defined results: null texts have no term and no rank; an item without a term, or without a document of its terms, has no row; equal
scores go by doc_id, null ids last; repeated rows are documents each; equal rows of items are one item, and rows of one item_id
with different texts are ranked each; very long texts are taken whole; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import ids_and_texts, materialise, slices
from augury.llm.decontam import _Words, seed_map, tokens

TOP = 10
BUNDLE = 256  # items that share their accumulators' rows, about
SHARES = (4096, 256, 16)  # an owner has the terms that at most one in so many documents holds; the last one all others
OWNERS = len(SHARES) + 1
POSTING = "shard string, term string, docs binary, tf binary, n binary, most_tf long, least_n long, ids array<string>, n_docs long, n_terms long"
STATE = "bundle long, shard string, items binary, docs binary, scores binary"


def item_terms(items: DataFrame) -> DataFrame:
    """bundle, idx (place of the item in it), item_id, term and times of every distinct item and each of its terms."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    bundles = F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) / BUNDLE))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("item_id", "text"), bundles))
    rows = materialise(rows.withColumn("idx", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id", "text")) - 1), "items")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            for bundle, idx, text in zip(piece["bundle"], piece["idx"], piece["text"], strict=True):
                found = Counter(tokens(text))
                if found:
                    yield pd.DataFrame({"bundle": bundle, "idx": idx, "term": [t.decode("utf-8", "replace") for t in found], "times": list(found.values())})

    terms = rows.select("bundle", "idx", "text").mapInPandas(count, "bundle long, idx int, term string, times long")
    return materialise(terms.join(rows.select("bundle", "idx", "item_id"), ["bundle", "idx"]), "item-terms")


def _sort_key(kind: T.DataType):
    number = isinstance(kind, T.IntegralType)
    return lambda x: (x is None, (int(x) if number else x.encode()) if x is not None else 0)


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Of each shard one row for a term that items may have (documents by their place in the shard, with occurrences and
    lengths, packed), and one without a term: the ids in their order, the documents with a term and all their terms."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for pdf in batches:
            yield pd.DataFrame({"seed": np.array([known[t.encode()] for t in pdf["term"]], np.uint64).view(np.int64)})

    bits = docs.sparkSession.sparkContext.broadcast(seed_map(terms.select("term").distinct().mapInPandas(name, "seed long")))
    by_id = _sort_key(docs.schema["doc_id"].dataType)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bitmap, part = _Words(), bits.value, TaskContext.get().partitionId()
        shift = 64 - int(len(bitmap) * 8).bit_length() + 1
        wanted: dict[bytes, bool] = {}
        for k, piece in enumerate(slices(batches)):
            order = sorted(range(len(piece)), key=lambda i: by_id(piece["doc_id"].iloc[i]))
            texts, lengths, found = piece["text"].to_numpy(), np.zeros(len(piece), np.int32), {}
            for at, i in enumerate(order):
                words = tokens(texts[i])
                lengths[at] = len(words)
                for word, times in Counter(words).items():
                    keep = wanted.get(word)
                    if keep is None:
                        slot = hashes[word] >> shift
                        keep = bool(bitmap[slot >> 3] >> (slot & 7) & 1)
                        if len(wanted) < 500_000:
                            wanted[word] = keep
                    if keep:
                        found.setdefault(word, ([], []))
                        found[word][0].append(at)
                        found[word][1].append(times)
            shard, out = f"{part}-{k}", []
            for word, (at, times) in found.items():
                n = lengths[at]
                out.append((shard, word.decode("utf-8", "replace"), np.array(at, np.int32).tobytes(), np.array(times, np.int32).tobytes(), n.tobytes(), max(times), int(n.min()), None, 0, 0))
            out.append((shard, None, None, None, None, 0, 0, [piece["doc_id"].iloc[i] for i in order], int((lengths > 0).sum()), int(lengths.sum())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in POSTING.split(", ")])

    return materialise(ids_and_texts(docs).mapInPandas(scan, POSTING), "postings")


def _saturated(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """A bound of the part of a contribution that occurrences and length decide: a little above it, as divisions are of doubles."""
    m = 24 + F.floor(n * float(75 * n_docs) / float(n_terms))
    return F.floor(1e9 * tf / (1000 * tf + 8 * m)).cast("long") + 1


def plan(terms: DataFrame, posted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """term, bundle, owner, w and items (idx, times, rest: what later owners add to the item's score at most) of the terms that
    have weight."""
    seen = posted.where("term is not null").groupBy("term").agg(F.sum(F.length("docs") / 4).cast("long").alias("df"), F.max("most_tf").alias("tf"), F.min("least_n").alias("n"))
    share = lambda k: F.col("df") * k <= n_docs
    owner = F.lit(OWNERS - 1)
    for k in reversed(range(len(SHARES))):
        owner = F.when(share(SHARES[k]), k).otherwise(owner)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = seen.select("term", owner.alias("owner"), weight.alias("w"), _saturated(F.col("tf"), F.col("n"), n_docs, n_terms).alias("best")).where("w > 0")
    own = terms.join(weighed, "term").withColumn("adds", F.col("times") * F.col("w") * F.col("best"))
    later = Window.partitionBy("bundle", "idx").orderBy("owner").rangeBetween(1, Window.unboundedFollowing)
    own = own.withColumn("rest", F.coalesce(F.sum("adds").over(later), F.lit(0)))
    # A bundle has about BUNDLE items.
    return own.groupBy("term", "bundle", "owner", "w").agg(F.collect_list(F.struct("idx", "times", "rest")).alias("items"))


def _step(n_docs: int, n_terms: int, last: bool):
    """One owner's turn: accumulators of a bundle in a shard and the owner's postings to new accumulators, or to the best rows."""

    def step(key, state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        unpack = lambda x, kind: np.frombuffer(x, kind)
        old = [(unpack(i, np.int32), unpack(d, np.int32), unpack(s, np.int64)) for i, d, s in zip(state["items"], state["docs"], state["scores"], strict=True)]
        rows, rest = [], {}
        for packed, tf, n, w, items in zip(found["docs"], found["tf"], found["n"], found["w"], found["items"], strict=True):
            tf, n = unpack(tf, np.int32).astype(np.int64), unpack(n, np.int32).astype(np.int64)
            rows.append((unpack(packed, np.int32), int(w) * ((10**9 * tf) // (1000 * tf + 8 * (25 + 75 * n * n_docs // n_terms))), items))
            rest.update((x["idx"], x["rest"]) for x in items)
        width = 1 + max([int(d.max()) for d, _, _ in rows] + [int(d.max()) for _, d, _ in old])
        height = 1 + max([*rest, *(int(i.max()) for i, _, _ in old)])
        total = np.zeros((height, width), np.int64)
        for i, d, s in old:
            np.add.at(total, (i, d), s)
        for docs, adds, items in rows:
            for x in items:
                total[x["idx"], docs] += x["times"] * adds  # a term has a document once
        out = []
        for i in np.flatnonzero(total.any(1)):
            at = np.flatnonzero(total[i])
            score = total[i, at]
            if len(at) > TOP and (last or int(i) in rest):
                least = np.partition(score, len(score) - TOP)[len(score) - TOP]
                keep = score >= (least if last else least - rest[int(i)])
                at, score = at[keep], score[keep]
            if last:
                first = np.lexsort((at, -score))[:TOP]
                at, score = at[first], score[first]
            out.append((np.full(len(at), i, np.int32), at.astype(np.int32), score))
        i, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
        if last:
            return pd.DataFrame({"bundle": key[0], "shard": key[1], "idx": i, "doc": d, "score": s})
        return pd.DataFrame([(key[0], key[1], i.tobytes(), d.tobytes(), s.tobytes())], columns=["bundle", "shard", "items", "docs", "scores"])

    return step


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` (``TOP`` at most) documents of each item."""
    if not 0 < top <= TOP:
        raise ValueError(f"top is from 1 to {TOP}")
    kind = docs.schema["doc_id"].dataType
    terms = item_terms(items)
    posted = postings(docs, terms)
    n_docs, n_terms = posted.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    addressed = materialise(plan(terms, posted, n_docs, max(1, n_terms)), "plan")
    rows = posted.where("term is not null").select("shard", "term", "docs", "tf", "n")
    state = docs.sparkSession.createDataFrame([], STATE)
    for owner in range(OWNERS):
        last = owner == OWNERS - 1
        own = rows.join(addressed.where(F.col("owner") == owner).drop("owner"), "term").select("bundle", "shard", "docs", "tf", "n", "w", "items")
        step = _step(n_docs, max(1, n_terms), last)
        state = state.groupBy("bundle", "shard").cogroup(own.groupBy("bundle", "shard")).applyInPandas(step, "bundle long, shard string, idx int, doc int, score long" if last else STATE)
    ids = posted.where("term is null").select("shard", "ids")
    best = state.join(ids, "shard").select("bundle", "idx", "score", "shard", "doc", F.get("ids", "doc").cast(kind).alias("doc_id"))
    order = Window.partitionBy("bundle", "idx").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "shard", "doc")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = terms.select("bundle", "idx", "item_id").distinct()
    return ranked.join(names, ["bundle", "idx"]).select("item_id", "rank", "doc_id", "score")
