"""Prefix trie of conversations by time-forward processing.

Every conversation is rebuilt: the first ``h`` turns come from the conversation that opens its block of ``BLOCK`` ids, the rest are
its own turns after the first ``h``.  A node of the trie is a distinct sequence of turns that rebuilt conversations begin with; it
is named by its depth and two 64-bit sums (exclusive-or) of hashes of its turns and their places, made by one running window over
a conversation.

What a node owes to its subtree (leaves, tokens saved) is summed by time-forward processing.  Nodes are cut into shards: a node
of rank r has between ``SHARD`` ** r and ``SHARD`` ** (r + 1) conversations, and a shard is a connected piece of one rank.  A
shard's paths are at most ``SHARD`` in number, however many conversations share a first turn.  Spark sorts the nodes of a task's
shards by reverse level order; each node takes what its children sent from a priority queue, which spills sorted runs to disk,
and sends its own totals to its parent.  What the tops of shards send goes to the nodes of higher ranks, summed by parent, and
these are processed in their turn: as many rounds as the conversations have digits to the base of ``SHARD``.

The ids of the conversations that end at a node are hashed in numeric order: joined in spans of ids, which bounds a row, and
streamed by node.

Defined results: turns with equal numbers go in the order of a hash of role and text, so repeated rows are turns each and reruns
agree; null turns come first; null roles and texts are empty; rows without a conv_id belong to no conversation and are left out;
an empty table has no node, not even the root.  A conversation is sorted in one task, which spills, so its length is bounded by
disk and not by memory.  Columns of the caller's other than the four are not read.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import materialise
from augury.llm.mixing import word_count

BLOCK = 20  # conversations that share the opening of the first of them
MOST_SHARED = 4  # h is below this
SHARD = 1024  # base of the ranks: paths in a shard at most
SALTS = 32
QUEUE_ROWS = 1_000_000  # messages that a queue holds in memory
SPAN = 65_536  # ids of conversations in one row at most
NODE = ["depth", "a", "b"]
MESSAGE = np.dtype([("key", "S24"), ("children", "i8"), ("leaves", "i8"), ("saved", "i8")])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), ta and tb (128 bits of hash of role and text) and words of every turn, without its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    thin = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("ta"), F.xxhash64(F.lit(2), role, text).alias("tb"), word_count(text).alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "ta", "tb")
    return thin.select("conv_id", F.row_number().over(order).alias("pos"), "ta", "tb", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, ta, tb, words, length (turns of the rebuilt conversation) of each rebuilt turn; depth 0 is its empty start.

    A block has at most 2 x BLOCK - 1 conversations, so the turns of its first go to few others.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"h": (F.crc32(c.cast("string").cast("binary")) % MOST_SHARED).cast("int"), "first": c - c % BLOCK})
    firsts = sizes.where(c == F.col("first")).select("first", F.col("n").alias("first_n"))
    convs = sizes.join(firsts, "first", "left").withColumn("k", F.least("h", F.coalesce("first_n", F.lit(0))))
    convs = convs.select("conv_id", "first", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    opening = turns.where((c % BLOCK == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "first")
    heads = convs.where("k > 0").join(opening, "first").where("pos <= k").select("conv_id", F.col("pos").alias("depth"), "ta", "tb", "words", "length")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "ta", "tb", "words", "length")
    starts = convs.select("conv_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ta"), F.lit(0).cast("long").alias("tb"), F.lit(0).cast("long").alias("words"), "length")
    return heads.unionByName(own).unionByName(starts)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, the node that each rebuilt turn leads to (depth, a, b), its parent (pa, pb), words and length."""
    here = lambda k: F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "ta", "tb", "depth")).otherwise(F.lit(0).cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rebuilt(turns).select("conv_id", "depth", "words", "length", here(1).alias("ha"), here(2).alias("hb"))
    rows = rows.withColumns({"a": F.bit_xor("ha").over(so_far), "b": F.bit_xor("hb").over(so_far)})
    return rows.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "words", "length")


def nodes_of(rows: DataFrame, shard: int) -> DataFrame:
    """Every node: its parent, words, n_convs, conv_id (smallest member), rank, and the top (ta, tb, its name) of its shard.

    Only nodes of ``shard`` conversations or more have a rank above 0; these are few and are joined back to the paths.
    """
    n = F.count(F.lit(1))
    power = F.lit(0)
    for r in range(1, int(62 / math.log2(shard)) + 1):
        power = F.when(F.col("n") >= shard**r, r).otherwise(power)
    large = rows.groupBy(*NODE).agg(n.alias("n")).where(F.col("n") >= shard).select(*NODE, power.alias("rank"))
    # The paths of a large node are salted and its row repeated for each salt.
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ranked = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(large, [*NODE, "salt"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    top = Window.partitionBy("conv_id", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = ranked.withColumns({"ta": F.first("a").over(top), "tb": F.first("b").over(top)})
    return named.groupBy(*NODE).agg(*[F.min(c).alias(c) for c in ("pa", "pb", "words", "conv_id", "rank", "ta", "tb")], n.alias("n_convs"))


def _keys(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of nodes as bytes that sort by falling depth, then as Spark sorts a and b."""
    signed = np.uint64(1 << 63)
    parts = np.column_stack([np.uint64(1 << 62) - depth.astype(np.uint64), a.astype(np.int64).view(np.uint64) ^ signed, b.astype(np.int64).view(np.uint64) ^ signed])
    return np.ascontiguousarray(parts.astype(">u8")).view("S24").ravel()


class SpillingQueue:
    """Messages in order of their keys.  Beyond ``most`` in memory, sorted runs go to unlinked files and are read by page."""

    def __init__(self, most: int = QUEUE_ROWS):
        self.most, self.fresh, self.near, self.held = most, [], np.zeros(0, MESSAGE), 0
        self.runs: list[np.ndarray] = []

    def push(self, messages: np.ndarray) -> None:
        self.fresh.append(messages)
        self.held += len(messages)
        if self.held > self.most:
            self._sort()
            with tempfile.TemporaryFile() as file:
                self.near.tofile(file)
                file.flush()
                self.runs.append(np.memmap(file, MESSAGE, "r", shape=self.near.shape))
            self.near, self.held = np.zeros(0, MESSAGE), 0

    def _sort(self) -> None:
        if self.fresh:
            both = np.concatenate([self.near, *self.fresh])
            self.near, self.fresh = both[np.argsort(both["key"], kind="stable")], []

    def pop(self, last: bytes) -> np.ndarray:
        """All messages to nodes up to ``last``."""
        self._sort()
        cut = np.searchsorted(self.near["key"], last, "right")
        found, self.near = [self.near[:cut]], self.near[cut:]
        self.held = len(self.near)
        for k, run in enumerate(self.runs):
            cut = np.searchsorted(run["key"], last, "right")
            if cut:
                found.append(np.array(run[:cut]))
                self.runs[k] = run[cut:]
        self.runs = [run for run in self.runs if len(run)]
        return np.concatenate(found)


def time_forward(batches: Iterator[pd.DataFrame], most: int = QUEUE_ROWS) -> Iterator[pd.DataFrame]:
    """Nodes in reverse level order with what came from lower ranks (children, leaves, saved), to nodes with their totals."""
    queue = SpillingQueue(most)
    for pdf in batches:
        depth, n = pdf["depth"].to_numpy(np.int64), len(pdf)
        key = _keys(depth, pdf["a"].to_numpy(), pdf["b"].to_numpy())
        up = _keys(np.maximum(depth - 1, 0), pdf["pa"].to_numpy(), pdf["pb"].to_numpy())
        inner = ~pdf["is_top"].to_numpy(bool)
        children, leaves, saved = (pdf[c].to_numpy(np.int64).copy() for c in ("children", "leaves", "saved"))
        saved += (pdf["n_convs"].to_numpy(np.int64) - 1) * pdf["words"].to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            if begin == end:
                continue
            got = queue.pop(key[end - 1])
            at = begin + np.searchsorted(key[begin:end], got["key"])
            for total, name in ((children, "children"), (leaves, "leaves"), (saved, "saved")):
                np.add.at(total, at, got[name])
            own = slice(begin, end)
            leaves[own] += children[own] == 0
            sent = np.flatnonzero(inner[own]) + begin
            if len(sent):
                messages = np.zeros(len(sent), MESSAGE)
                messages["key"], messages["children"], messages["leaves"], messages["saved"] = up[sent], 1, leaves[sent], saved[sent]
                queue.push(messages)
        yield pdf.assign(children=children, leaves=leaves, saved=saved)


def subtree_totals(nodes: DataFrame, rounds: int, most: int = QUEUE_ROWS) -> DataFrame:
    """``nodes`` with children, leaves and saved, rank by rank."""
    sums = ["children", "leaves", "saved"]
    done: list[DataFrame] = []
    nodes = nodes.withColumn("is_top", (F.col("ta") == F.col("a")) & (F.col("tb") == F.col("b")))
    columns = [*NODE, "pa", "pb", "is_top", "conv_id", "n_convs", "words"]
    schema = "depth int, a long, b long, pa long, pb long, is_top boolean, conv_id long, n_convs long, words long, children long, leaves long, saved long"
    for rank in range(rounds):
        own = nodes.where(F.col("rank") == rank)
        if done:
            tops = [d.where("is_top and depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(1).cast("long").alias("children"), "leaves", "saved") for d in done]
            sent = tops[0]
            for t in tops[1:]:
                sent = sent.unionByName(t)
            own = own.join(sent.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums]), NODE, "left")
        else:
            own = own.withColumns({c: F.lit(0) for c in sums})
        own = own.select("ta", "tb", *columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums])
        ordered = own.repartition("ta", "tb").sortWithinPartitions(F.desc("depth"), "a", "b").select(*columns, *sums)
        done.append(materialise(ordered.mapInPandas(lambda batches: time_forward(batches, most), schema), f"trie-{rank}"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def ends_hashes(rows: DataFrame) -> DataFrame:
    """Node and ends_sha256 of every node at which conversations end; ids are streamed in order, a span of them to a row."""
    ends = rows.where("depth = length").groupBy(*NODE, F.floor(F.col("conv_id") / SPAN).alias("span")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for pdf in batches:
            out = []
            for *node, ids in zip(pdf["depth"].tolist(), pdf["a"].tolist(), pdf["b"].tolist(), pdf["ids"], strict=True):
                if node != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*NODE, "ends_sha256"])

    ordered = ends.repartition(*NODE).sortWithinPartitions(*NODE, "span").select(*NODE, "ids")
    return ordered.mapInPandas(digest, "depth int, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard: int = SHARD, most: int = QUEUE_ROWS) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    turns = materialise(numbered_turns(conversations), "turns")
    rows = materialise(paths(turns), "paths")
    n = rows.where("depth = 0").count()
    rounds = next(r for r in range(1, 64) if shard**r > n)
    nodes = materialise(nodes_of(rows, shard), "nodes")
    totals = subtree_totals(nodes, rounds, most)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    found = totals.join(parents, ["depth", "pa", "pb"], "left").join(ends_hashes(rows), NODE, "left")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return found.select(
        "conv_id", long("depth", "depth"), "parent_conv_id", "n_convs", long("children", "n_children"), long("leaves", "n_leaves"), long("saved", "saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
