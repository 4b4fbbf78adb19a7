"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``SEED_WORDS`` words (a shorter item is one seed), named by rolling Karp-Rabin hashes.  Each text is rolled over
once; the hashes that a bit map of all benchmark seeds may hold are joined to the seeds in Spark.  Pairs of a text and an item
whose shared seeds could cover ``threshold`` of the item (a seed covers its own words at most) are tiled: the longest matches
that do not overlap marked words are marked one after the other, and the share of the item's words that end up marked is its
coverage.  Passages whose sentences were reordered keep their coverage.  A document is contaminated by an item covered to
``threshold`` or more.

Seeds that more than ``HOT_ITEMS`` items share, such as those of a common opening, would pair every text that has one with every
such item.  To reach the threshold an item needs a least number of seeds, so as many of its seeds as fall short of that, the most
common first, can be left out of the join: a text that reaches the threshold has others of the item (the pigeonhole rule).

Nothing that grows with the benchmark is broadcast: the bit map has a fixed most size, beyond which it only lets more hashes
through to the join, which decides.  Texts that are equal are one text until the end.

Words are runs of anything but ASCII white space and punctuation, A-Z in lower case.  Defined results: null and empty texts
share nothing; items without an id, text or word are left out; an item of fewer than five words must be found whole; rows of one
item_id with different texts are items of their own; ties of coverage go to the smaller item; very long texts are searched
whole; repeated rows get equal results; columns of the caller's keep their names, and results take the next free name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import free_name, materialise, slices

SEED_WORDS = 5
THRESHOLD = 0.8
HOT_ITEMS = 16  # items that share a seed, beyond which it is left out where it can be
MAP_BITS = (16, 27)  # least and most binary digits of the bit map's size: 16 MB at most
_SPARE = 4096  # places of the map for each seed, up to its most size
_CHUNK = 4096  # places of a text whose matches are held at once

# Upper case to lower case, ASCII punctuation and control characters to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KNOWN_WORDS = 500_000  # words whose hashes a task keeps


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all runs of ``width`` word hashes."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * _BASE + words[k : k + n]
    return out * np.uint64(2) + np.uint64(width & 1)  # runs of different widths stay apart as well as hashes do


class _Words(dict):
    """Hashes of words, each worked out once."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) < _KNOWN_WORDS:
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """item (a number of the text and id), item_id, n (words), width and seeds (hashes by place, packed) of every item."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for piece in slices(batches):
            words = [known.of(t) for t in piece["text"]]
            width = [min(SEED_WORDS, len(w)) for w in words]
            yield pd.DataFrame({"item": piece["item"], "n": [len(w) for w in words], "width": width, "seeds": [window_hashes(w, k).tobytes() if k else b"" for w, k in zip(words, width, strict=True)]})

    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().withColumn("item", F.md5(F.concat_ws("|", F.col("item_id").cast("string"), "text")))
    made = rows.select("item", "text").mapInPandas(make, "item string, n int, width int, seeds binary").where("n > 0")
    return materialise(made.join(rows.select("item", "item_id"), "item"), "items")


def seed_rows(items: DataFrame) -> DataFrame:
    """item, n, width and seed: a row for each distinct seed of an item, with times (places of it there)."""

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, n, width, packed in zip(pdf["item"], pdf["n"], pdf["width"], pdf["seeds"], strict=True):
                seed, times = np.unique(np.frombuffer(packed, np.int64), return_counts=True)
                yield pd.DataFrame({"item": item, "n": n, "width": width, "seed": seed, "times": times})

    return items.select("item", "n", "width", "seeds").mapInPandas(unfold, "item string, n int, width int, seed long, times long")


def telling_seeds(seeds: DataFrame, threshold: float) -> DataFrame:
    """``seeds`` without those that need not be joined, with spared (places of the item that have one of these).

    ``need`` is the least number of seeds in a text with which an item can reach the threshold: a seed covers its own words at
    most.  An item's seeds are as many as its words, so its window is small.
    """
    shared = seeds.groupBy("width", "seed").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > HOT_ITEMS)
    need = F.ceil(F.col("n") * threshold / F.col("width") - 1e-9)
    upto = Window.partitionBy("item").orderBy(F.desc_nulls_last("items"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    marked = seeds.join(shared, ["width", "seed"], "left").withColumn("upto", F.sum("times").over(upto))
    left_out = F.col("items").isNotNull() & (F.col("upto") < need)
    marked = marked.withColumn("out", left_out).withColumn("spared", F.coalesce(F.sum(F.when(left_out, F.col("times"))).over(Window.partitionBy("item")), F.lit(0)))
    return marked.where("not out").drop("items", "upto", "out")


def seed_map(seeds: DataFrame) -> np.ndarray:
    """Bit map of the seeds' hashes."""
    least, most = MAP_BITS
    digits = min(most, max(least, int(np.ceil(np.log2(max(1, seeds.count()) * _SPARE)))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 15, bool)
        bits[pdf["slot"].to_numpy() & ((1 << 15) - 1)] = True
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slots = seeds.select((F.shiftrightunsigned("seed", 64 - digits)).alias("slot")).distinct().withColumn("page", F.shiftright("slot", 15))
    out = np.zeros((1 << digits) // 8, np.uint8)
    for r in slots.groupBy("page").applyInPandas(pack, "page long, bits binary").collect():  # 4096 pages of 4 KB at most
        out[r["page"] * 4096 : r["page"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def text_hits(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """digest, width, n_hits, places and seeds (packed) of each text that has seeds which the map may hold; map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = _Words(), shared.value
        shift = np.uint64(64 - int(len(bits) * 8).bit_length() + 1)
        for piece in slices(batches):
            out = []
            for digest, text in zip(piece["digest"], piece["text"], strict=True):
                words = known.of(text)
                for width in widths:
                    seeds = window_hashes(words, width)
                    slot = (seeds >> shift).astype(np.int64)
                    at = np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)
                    if len(at):
                        out.append((digest, width, at.astype(np.int64).tobytes(), seeds[at].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["digest", "width", "places", "seeds"])

    return docs.select(_digest().alias("digest"), "text").where("text is not null").mapInPandas(search, "digest string, width int, places binary, seeds binary")


def _digest():
    return F.md5(F.col("text"))


def matches(place: np.ndarray, seed: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal runs (first place in the item, first place in the text, seeds) of seeds that follow each other in both.

    The text is walked by pieces and runs are carried on from one to the next, so equal seeds never meet in one table of pairs.
    """
    order = np.argsort(item, kind="stable")
    known = item[order]
    going: dict[int, tuple[int, int, int]] = {}  # by diagonal: first place in the item and in the text, and the last there
    for m in range(0, len(place), _CHUNK):
        at, own = place[m : m + _CHUNK], seed[m : m + _CHUNK]
        low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
        n = high - low
        where = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        by = np.lexsort((at, at - where))
        where, at = where[by], at[by]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at - where) != 0) | (np.diff(at) != 1)]))
        for first, end in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
            p, d, last = int(where[first]), int(at[first]), int(at[end - 1])
            before = going.pop(d - p, None)
            if before is not None and before[2] + 1 == d:
                p, d = before[0], before[1]
            elif before is not None:
                yield before[0], before[1], before[2] - before[1] + 1
            going[d - p] = (p, d, last)
    for p, d, last in going.values():
        yield p, d, last - d + 1


def tile(found: Iterator[tuple[int, int, int]], n: int, width: int) -> float:
    """Share of an item's ``n`` words that greedy string tiling marks, from maximal matches (in seeds of ``width`` words)."""
    heap = [(-(seeds + width - 1), p, d) for p, d, seeds in found]
    heapq.heapify(heap)
    item, text = np.zeros(n, bool), _Marks()
    while heap and not item.all():
        size, p, d = heapq.heappop(heap)
        size = -size
        free = ~(item[p : p + size] | text.marked(d, size))
        if free.all():
            item[p : p + size] = True
            text.mark(d, size)
            continue
        # What is left of the match between marked words comes up again in order of length.
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin >= width:
                heapq.heappush(heap, (begin - end, p + begin, d + begin))
    return float(item.mean())


class _Marks:
    """Marked words of a text, in pages of bits that are made when needed."""

    def __init__(self):
        self.pages: dict[int, np.ndarray] = {}

    def _spans(self, d: int, size: int) -> Iterator[tuple[int, int, int]]:
        while size > 0:
            step = min(size, 1024 - d % 1024)
            yield d // 1024, d % 1024, step
            d, size = d + step, size - step

    def marked(self, d: int, size: int) -> np.ndarray:
        empty = np.zeros(1024, bool)
        return np.concatenate([self.pages.get(page, empty)[at : at + step] for page, at, step in self._spans(d, size)])

    def mark(self, d: int, size: int) -> None:
        for page, at, step in self._spans(d, size):
            self.pages.setdefault(page, np.zeros(1024, bool))[at : at + step] = True


def coverage(text: str | None, item: str | None) -> float:
    """Share of the item's words that tiling marks in the text."""
    known = _Words()
    words, mine = known.of(text), known.of(item)
    width = min(SEED_WORDS, len(mine))
    if not width:
        return 0.0
    seeds = window_hashes(words, width).view(np.int64)
    return tile(matches(np.arange(len(seeds)), seeds, window_hashes(mine, width).view(np.int64)), len(mine), width)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """digest (md5 of the text), coverage and item_id (of the best covered item) and n_items (covered to the threshold) of each
    distinct text that an item covers to the threshold."""
    items = item_seeds(benchmark)
    every = materialise(seed_rows(items), "seeds")
    telling = materialise(telling_seeds(every, threshold), "telling")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # SEED_WORDS numbers at most
    hits = materialise(text_hits(docs, seed_map(every), widths).dropDuplicates(["digest", "width"]), "hits")

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seeds = [np.unique(np.frombuffer(packed, np.int64)) for packed in pdf["seeds"]]
            n = [len(x) for x in seeds]
            if n:
                yield pd.DataFrame({"digest": np.repeat(pdf["digest"].to_numpy(), n), "width": np.repeat(pdf["width"].to_numpy(), n), "seed": np.concatenate(seeds)})

    mine = hits.select("digest", "width", "seeds").mapInPandas(unfold, "digest string, width int, seed long")
    shared = mine.join(telling, ["width", "seed"]).groupBy("digest", "item").agg((F.sum("times") + F.first("spared")).alias("times"), F.first("n").alias("n"), F.first("width").alias("width"))
    pairs = shared.where(F.col("times") * F.col("width") >= F.col("n") * threshold - 1e-9).select("digest", "item", "n", "width")

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            share = [
                tile(matches(np.frombuffer(places, np.int64), np.frombuffer(own, np.int64), np.frombuffer(item, np.int64)), n, width)
                for places, own, item, n, width in zip(pdf["places"], pdf["own"], pdf["seeds"], pdf["n"], pdf["width"], strict=True)
            ]
            yield pd.DataFrame({"digest": pdf["digest"], "item": pdf["item"], "coverage": share})

    both = pairs.join(hits.withColumnRenamed("seeds", "own"), ["digest", "width"]).join(items.select("item", "seeds"), "item")
    covered = both.select("digest", "item", "n", "width", "places", "own", "seeds").mapInPandas(cover, "digest string, item string, coverage double").where(F.col("coverage") >= threshold)
    named = covered.join(items.select("item", "item_id"), "item")
    best = named.groupBy("digest").agg(F.max("coverage").alias("coverage"), F.min_by("item_id", F.struct(-F.col("coverage"), "item_id")).alias("item_id"), F.count(F.lit(1)).cast("int").alias("n_items"))
    return materialise(best, "leaks")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with contaminated, coverage (of the best item; 0 if none reaches the threshold), item_id (of it) and
    n_items (at the threshold)."""
    found = leaks(docs, benchmark, threshold)
    names: dict[str, str] = {}
    for c in ("contaminated", "coverage", "item_id", "n_items", "digest"):
        names[c] = free_name([*docs.columns, *names.values()], c)
    held = names["digest"]
    joined = docs.withColumn(held, _digest()).join(found.select(F.col("digest").alias(held), F.struct("coverage", "item_id", "n_items").alias(f"{held}_best")), held, "left")
    best = F.col(f"{held}_best")
    return joined.select(
        *docs.columns, best.isNotNull().alias(names["contaminated"]), F.coalesce(best["coverage"], F.lit(0.0)).alias(names["coverage"]),
        best["item_id"].alias(names["item_id"]), F.coalesce(best["n_items"], F.lit(0)).alias(names["n_items"]),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no item covers to the threshold."""
    held = free_name(docs.columns, "digest")
    found = leaks(docs, benchmark, threshold).select(F.col("digest").alias(held))
    return docs.withColumn(held, _digest()).join(found, held, "left_anti").select(*docs.columns)
