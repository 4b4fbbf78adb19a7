"""MinHash near-duplicates by an LSH forest.

A text is the set of its word shingles.  ``VALUES`` minimum hashes of the set make its signature; the first ``POOL`` of them, taken
some at a time in several orders, are the trees: the texts that share the first values of an order are neighbours by longest
common prefix, a region.  Regions of ``REGION`` texts or fewer are compared whole, by the bits in which sketches (the lowest bit
of each minimum) differ.  A larger region is looked at by its first text alone, and those of its texts that have too few
sparse orders to have met their partners there go on to the next round, where prefixes are longer and orders more, unless all are
joined to one already; what is too large in the last round is compared in parts.
Depth thus follows the density of a region, no candidate is dropped, and a crowd of copies is never unfolded into pairs.

Candidates only name components of texts to compare: within these a link holds if the Jaccard similarity of the full sets reaches
``ALIKE``.

The chance that a pair at exactly 0.8 meets in no order is 4e-9 where no order is crowded and at most ``MISS`` a round where some
are, and about 1e-5 in the last round; that its sketches lie beyond ``RADIUS`` is 4e-9 (computed, not measured).

Defined results: a text of fewer words than a shingle is one shingle; texts without words have no shingle, are linked with nothing
and stand for themselves; repeated rows and texts of equal sets share a component; null ids are never a component's name (a
component of null ids alone is null, and its rows are kept); very long texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm import simhash
from augury.llm.common import materialise, slices

SHINGLE_WORDS = 4
ALIKE = 0.8
VALUES, POOL = 256, 72  # minimum hashes of a set, and those of them that orders use
RADIUS = 60  # bits of 256 in which the sketches of candidates differ at most: 26 on average at a similarity of 0.8
ROUNDS = ((1, 12), (3, 24), (6, 64))  # values of a prefix, and orders
MISS = 2e-5  # chance at which a pair at a similarity of ALIKE may meet in none of a text's sparse orders
REGION = 256  # texts of a region that are compared whole
PART = 16_384  # texts of a region that one side of a task compares in the last round
_CHUNK = 2048  # shingles hashed at once
_RNG = np.random.default_rng(7)
_MASK = _RNG.integers(0, 2**64, VALUES, np.uint64)
_FACTOR = _RNG.integers(0, 2**64, VALUES, np.uint64) | np.uint64(1)
_SKETCH = ["s0", "s1", "s2", "s3"]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of a set of hashes under each of ``VALUES`` functions; all ones for an empty set."""
    out = np.full(VALUES, 2**32 - 1, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        out = np.minimum(out, (((hashes[k : k + _CHUNK, None] ^ _MASK) * _FACTOR) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, node (names the set), size (shingles in it), sig (values for the orders) and fp (the sketch) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            sets = [np.unique(simhash.shingles(t, width)) for t in piece["text"]]
            sigs = [signature(x) for x in sets]
            bits = np.packbits(np.array(sigs, np.uint32).reshape(-1, VALUES) & np.uint32(1), axis=1)
            yield pd.DataFrame({
                "doc_id": piece["doc_id"], "row": piece["row"], "node": [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], "size": [len(x) for x in sets],
                "sig": [x[:POOL].view(np.int32) for x in sigs], "fp": [x.tobytes().hex() for x in bits],
            })

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), simhash.row_hash().alias("row"), "text")
    return rows.mapInPandas(make, "doc_id string, row long, node string, size long, sig array<int>, fp string").withColumn("doc_id", F.col("doc_id").cast(kind))


def orders(depth: int, n: int) -> list[list[int]]:
    """Places in the pool that the prefixes of ``n`` orders have: disjoint ones until the pool is used up, then dealt anew."""
    rng, left, out = random.Random(depth), [], []
    while len(out) < n:
        if len(left) < depth:
            left = rng.sample(range(POOL), POOL)
        out.append([left.pop() for _ in range(depth)])
    return out


def _prefixes(nodes: DataFrame, depth: int, n: int) -> DataFrame:
    """A row of (key, id, comp, sketch) for each node and order; the key names the order and the prefix."""
    keys = F.transform(F.lit(orders(depth, n)), lambda places, k: F.xxhash64(k, F.transform(places, lambda i: F.get("sig", i))))
    return nodes.select(F.explode(keys).alias("key"), "id", "comp", *_SKETCH)


def _forest(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """What edges (u, v) between rows join, as few edges (u, v) of ids."""
    names, at = np.unique(ids, return_inverse=True)
    forest = simhash._Forest(len(names))
    forest.add(at[u], at[v])
    forest.settle()
    child = np.flatnonzero(forest.parent != np.arange(len(names)))
    return pd.DataFrame({"u": names[child], "v": names[forest.parent[child]]})


def neighbours(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Near pairs of rows with equal keys, as forests, from rows sorted by key; regions are small and may span two batches."""
    rest = None
    for pdf in batches:
        rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = rows["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield _near_rows(rows.iloc[:cut], radius)
    if rest is not None and len(rest):
        yield _near_rows(rest, radius)


def _near_rows(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    key, comp, ids = (rows[c].to_numpy() for c in ("key", "comp", "id"))
    sketch = rows[_SKETCH].to_numpy(np.int64).view(np.uint64)
    found_u, found_v, at = [], [], np.arange(len(key))
    step = 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]  # rows with no partner this far have none beyond
        if not len(at):
            break
        apart = at[comp[at] != comp[at + step]]
        near = apart[np.bitwise_count(sketch[apart] ^ sketch[apart + step]).sum(1, dtype=np.int64) <= radius]
        found_u.append(near)
        found_v.append(near + step)
        step += 1
    none = np.zeros(0, np.int64)
    return _forest(ids, np.concatenate([none, *found_u]), np.concatenate([none, *found_v]))


def _from_first(large: DataFrame, radius: int) -> DataFrame:
    """Edges from the first text of each region to those near it."""
    first = large.groupBy("key").agg(F.min(F.struct("id", *_SKETCH)).alias("first"))
    apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"first.{s}"))) for s in _SKETCH), F.lit(0))
    return large.join(first, "key").where((apart <= radius) & (F.col("id") != F.col("first.id"))).select(F.col("id").alias("u"), F.col("first.id").alias("v")).distinct()


def _in_parts(large: DataFrame, radius: int, part: int) -> DataFrame:
    """Edges of all near pairs of large regions: a task for each pair of parts, which hold about ``part`` texts."""
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int")
    rows = large.select("key", "id", *_SKETCH, own.alias("g"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("h")).select("key", "id", *_SKETCH, "g", F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "id"])
        sketch, ids = pdf[_SKETCH].to_numpy(np.int64).view(np.uint64), pdf["id"].to_numpy()
        left = int((pdf["g"] == pdf["p"]).sum())
        u, v = simhash.links(sketch[:left], None if left == len(pdf) else sketch[left:], radius)
        return pd.DataFrame({"u": ids[u], "v": ids[v]})

    return rows.groupBy("key", "p", "q").applyInPandas(compare, "u long, v long")


def candidates(nodes: DataFrame, radius: int = RADIUS, rounds: tuple = ROUNDS, region: int = REGION, part: int = PART) -> DataFrame:
    """id and root of the nodes (id, sig, sketch) that are joined to others by near neighbours in some order.

    ``comp`` is a first text that a node is known to be joined to; a crowded region of one comp alone is done.
    """
    found, active = [], nodes.withColumn("comp", F.col("id"))
    for k, (depth, n) in enumerate(rounds):
        rows, last = _prefixes(active, depth, n), k == len(rounds) - 1
        spread = [F.min("comp").alias("lo"), F.max("comp").alias("hi")] if k else [F.lit(0).alias("lo"), F.lit(1).alias("hi")]
        crowded = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *spread).where(F.col("n") > region).select("key", "n", (F.col("lo") < F.col("hi")).alias("open")), f"crowded-{k}")
        sparse = rows.join(crowded.select("key"), "key", "left_anti")
        edges = sparse.repartition("key").sortWithinPartitions("key").mapInPandas(lambda b: neighbours(b, radius), "u long, v long")
        if crowded.where("open").isEmpty():
            found.append(edges)
            break
        large = materialise(rows.join(crowded.where("open").drop("open"), "key"), f"large-{k}")
        if last:
            found += [edges, _in_parts(large, radius, part)]
            break
        first = materialise(_from_first(large, radius), f"first-{k}")
        found += [edges, first]
        joined = first.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("first"))
        # A text with enough sparse orders has met all its partners in them.
        enough = math.ceil(math.log(MISS) / math.log(1 - ALIKE**depth))
        again = large.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n - enough).select("id")
        # What goes on is written once: the next round reads it twice, and the one after takes its own texts from it.
        active = materialise(active.drop("comp").join(again, "id", "left_semi").join(joined, "id", "left").withColumn("comp", F.least("id", "first")).drop("first"), f"active-{k}")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return simhash.components(edges).withColumnRenamed("fp", "id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, alike: float = ALIKE, radius: int = RADIUS, rounds: tuple = ROUNDS, region: int = REGION, part: int = PART) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id that links reach) and kept of every row."""
    made = materialise(shingle_sets(docs, width), "sets")
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")
    nodes = made.where("size > 0").groupBy("node").agg(named, F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("sig").alias("sig"))
    nodes = materialise(nodes.withColumn("id", F.xxhash64("node")), "nodes")
    word = lambda k: F.conv(F.substring("fp", 16 * k + 1, 16), 16, -10).cast("long").alias(f"s{k}")
    joined = candidates(nodes.select("id", "sig", *[word(k) for k in range(4)]), radius, rounds, region, part)
    rooted = materialise(nodes.join(joined, "id", "left").select("node", "fp", "row", "size", F.coalesce("root", "id").alias("root")), "rooted")
    found = simhash.confirmed(docs, made.where("size > 0").select("doc_id", "row", "node", "size"), nodes.select("node", "first"), rooted, width, alike, radius)
    alone = made.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    both = found.select("doc_id", "size", "component_id").unionByName(alone)
    return both.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
