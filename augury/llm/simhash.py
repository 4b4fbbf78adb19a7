"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in one pass over the texts.  The distinct ones are dealt by a hash into groups of bounded size; each
pair of groups is one task, in which both are sorted into tiles by the population counts of their halves.  Tiles whose counts
differ by more than the radius hold no link and are skipped; the others are compared with exclusive-or and bit counts.  A task
returns a spanning forest of its links, never all pairs, and the forests are joined by alternating stars.

Defined results: null and wordless texts have fingerprint zero, which links like any other; fewer words than a shingle give one
shingle of all; repeated rows share their fingerprint and component; null ids are never a component's name (a component
of null ids alone is null).  The comparison is exact and thus grows with the square of the distinct fingerprints; the skipped
tiles lower the factor, not the power.

Where texts must be alike in a share of their shingles (``alike_components``), fingerprints only name candidates: their texts
are fetched and a link holds if the Jaccard similarity of the two sets of shingles reaches the share.  Sets that alike are nearly
of one size, so the distinct fingerprints are dealt by size too, and only those of sizes that can be linked are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import free_name, ids_and_texts, materialise, slices

SHINGLE_WORDS = 4
RADIUS = 4
GROUP = 262_144  # distinct fingerprints in a group at most, as dealt by a hash
SPREAD = (16_384, 8)  # fewer make groups of the first size, up to the second number of groups, to keep tasks busy
# Candidates for texts alike in 0.8: fingerprints of sets of shingles then differ in 39 of 256 bits on average, in 48 for the
# shortest such texts (4 of 5 shingles); the radius is over 4.5 standard deviations beyond either.  Unrelated texts differ in 128.
SHARED = {"width": 5, "alike": 0.8, "bits": 256, "radius": 76}
SIZES = (2, 65_536)  # bands of sizes between the sizes of two sets that can just be alike; fingerprints of a group of one band at most
PIECE = (1 << 17, 8192)  # pairs, and fingerprints of one side, that are compared at once: what is made for them stays in the cache
PART = (4096, 2_000_000)  # texts and shingles of candidates that one side of a task verifies, about
_SEED = 42


def _words(k: int, hashes: np.ndarray) -> np.ndarray:
    """Word ``k`` of wide hashes: the hash itself, then mixes of it."""
    if k:
        hashes = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
        hashes = hashes ^ (hashes >> np.uint64(31))
    return hashes


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word shingles of a text in their order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = end[width - 1 :] if len(words) > width else end[-1:]
    first = np.concatenate([[0], end + 1])[: len(last)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], _SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last))


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, bits: int = 64) -> str:
    """SimHash over word shingles in hex, repeats included; a bit is 1 if it is set in over half of the hashes."""
    return _folded(shingles(text, width), bits)


def _folded(hashes: np.ndarray, bits: int) -> str:
    if not len(hashes):
        return "0" * (bits // 4)
    out = ""
    for k in range(bits // 64):
        counts = np.zeros(64, np.int64)
        for m in range(0, len(hashes), 65_536):
            counts += np.unpackbits(_words(k, hashes[m : m + 65_536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out += format(int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]), "016x")
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = 64) -> DataFrame:
    """doc_id and fp (the fingerprint in hex) of every row; map-only."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            yield pd.DataFrame({"doc_id": piece["doc_id"], "fp": [fingerprint(t, width, bits) for t in piece["text"]]})

    return ids_and_texts(docs).mapInPandas(make, "doc_id string, fp string").withColumn("doc_id", F.col("doc_id").cast(kind))


class _Forest:
    """Union-find over numbers 0..n-1 that takes edges in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.waiting.append((u, v))
        self.held += len(u)
        if self.held > 500_000:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        u, v = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        while True:
            a, b = self.parent[u], self.parent[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def _numbers(fps, bits: int | None = None) -> np.ndarray:
    """Fingerprints, in hex or as packed bytes, as a row of 64-bit words each."""
    if not isinstance(fps, bytes):
        fps = list(fps)
        bits, fps = 4 * len(fps[0]) if fps else 64, bytes.fromhex("".join(fps))
    return np.frombuffer(fps, ">u8").astype(np.uint64).reshape(-1, bits // 64)


def _names(fps: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in fps.astype(">u8")]


def _tiles(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Population counts of the two halves of the bits, in steps."""
    if x.shape[1] == 1:
        x = np.concatenate([x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)], 1)
    counts, half = np.bitwise_count(x).astype(np.int64), x.shape[1] // 2
    return counts[:, :half].sum(1) // step, counts[:, half:].sum(1) // step


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    wide = max(1, min(PIECE[1], len(b)))
    rows = max(1, min(PIECE[0] // wide, len(a)))
    both, count, more = (np.empty((rows, wide), kind) for kind in (np.uint64, np.uint8, np.uint8))
    found = []
    for k in range(0, len(b), wide):
        far = right[:, k : k + wide]
        for m in range(0, len(a), rows):
            near = left[:, m : m + rows]
            at = np.s_[: near.shape[1], : far.shape[1]]
            apart, held, own = both[at], count[at], more[at]
            np.bitwise_count(np.bitwise_xor(near[0][:, None], far[0], out=apart), out=held)
            for word in range(1, len(left)):
                np.add(held, np.bitwise_count(np.bitwise_xor(near[word][:, None], far[word], out=apart), out=own), out=held)
            hit = held <= radius
            if hit.any():
                i, j = np.nonzero(hit)
                found.append((i + m, j + k))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(left) > 3:  # sums from 256 on began again at 0
        true = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= radius
        i, j = i[true], j[true]
    return i, j


def links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``a``, or between ``a`` and ``b``, as row numbers (node, root); those of ``b``
    come after those of ``a``.  Tiles are the rows whose halves have like population counts, in steps of ``step``; tiles whose
    counts must differ by more than the radius are skipped.
    """
    step, base = max(1, radius // 8), 1 << 20
    same = b is None
    key_l = (lambda t: t[0] * base + t[1])(_tiles(a, step))
    at_l = np.argsort(key_l, kind="stable")
    left, key_l = a[at_l], key_l[at_l]
    at_r, right, key_r = at_l, left, key_l
    if not same:
        key_r = (lambda t: t[0] * base + t[1])(_tiles(b, step))
        at_r = np.argsort(key_r, kind="stable")
        right, key_r = b[at_r], key_r[at_r]
        at_r = at_r + len(a)
    forest = _Forest(len(a) + (0 if same else len(b)))
    tiles = np.flatnonzero(np.concatenate([[True], np.diff(key_l) != 0])) if len(left) else np.zeros(0, np.int64)
    ends = np.concatenate([tiles[1:], [len(left)]])
    reach = lambda rest: (rest - 1) // step + 1 if rest > 0 else 0  # noqa: E731  steps that counts at most ``rest`` apart can be apart
    for begin, end in zip(tiles, ends, strict=True):
        high, low = divmod(int(key_l[begin]), base)
        for d in range(0 if same else -reach(radius), reach(radius) + 1):
            more = reach(radius - ((abs(d) - 1) * step + 1 if d else 0))
            start, stop = np.searchsorted(key_r, [(high + d) * base + max(0, low - more), (high + d) * base + low + more + 1])
            if same:
                start = max(start, begin)
            width = max(1, block // max(1, min(block, end - begin)))
            for k in range(start, stop, width):
                far = right[k : min(stop, k + width)]
                for m in range(begin, end, block):
                    i, j = _near(left[m : min(end, m + block)], far, radius)
                    i, j = at_l[i + m], at_r[j + k]
                    if same:
                        i, j = i[i != j], j[i != j]
                    if len(i):
                        forest.add(i, j)
    forest.settle()
    child = np.flatnonzero(forest.parent != np.arange(len(forest.parent)))
    return child, forest.parent[child]


def size_band(size: Column, alike: float) -> Column:
    """A whole number that differs by ``SIZES[0]`` at most between sizes of sets with a Jaccard similarity of ``alike`` or more."""
    return (F.floor(F.log(F.greatest(size, F.lit(1))) * (SIZES[0] / -math.log(alike)) + 1e-9) if 0 < alike < 1 else F.lit(0)).cast("int")


def link_forest(distinct: DataFrame, radius: int = RADIUS, group: int | None = None, bits: int = 64, reach: int = 0) -> DataFrame:
    """Edges (u, v) that connect what links join, of a table of distinct fingerprints ``fp``; if it has ``band``, of those whose
    bands are at most ``reach`` apart."""
    banded = "band" in distinct.columns
    distinct = distinct if banded else distinct.withColumn("band", F.lit(0))
    most, spans, start = group or (SIZES[1] if banded else GROUP), [], 0
    for r in distinct.groupBy("band").agg(F.count(F.lit(1)).alias("n")).orderBy("band").collect():  # a row for each band, under 200
        parts = max(1, -(-r["n"] // most), min(SPREAD[1], -(-r["n"] // SPREAD[0])) if group is None else 1)
        spans.append((r["band"], start, parts))
        start += parts
    # Groups are numbered by band, so that those which a group meets follow each other.
    meets = [(band, first, parts, min(x[1] for x in spans if x[0] >= band - reach), max(x[1] + x[2] - 1 for x in spans if x[0] <= band + reach)) for band, first, parts in spans]
    of = F.broadcast(distinct.sparkSession.createDataFrame(meets, "band int, first int, parts int, low int, high int"))
    # One packed row a group: 2 MB for a full one.  It goes to as many tasks as there are groups that it meets.
    own = (F.col("first") + F.pmod(F.xxhash64("fp", F.lit("group")), F.col("parts"))).cast("int")
    packed = distinct.join(of, "band").groupBy(own.alias("g"), "low", "high").agg(F.unhex(F.array_join(F.collect_list("fp"), "")).alias("fps"))
    pairs = packed.select("g", "fps", F.explode(F.sequence("low", "high")).alias("h")).select(F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q"), "fps")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [_numbers(bytes(x), bits) for x in pdf["fps"]]
        if len(sides) == 1 and pdf["p"].iloc[0] != pdf["q"].iloc[0]:
            return pd.DataFrame({"u": [], "v": []}).astype(str)
        u, v = links(sides[0], sides[1] if len(sides) > 1 else None, radius)
        both = np.concatenate(sides)
        return pd.DataFrame({"u": _names(both[u]), "v": _names(both[v])}).astype(str)

    return pairs.groupBy("p", "q").applyInPandas(compare, "u string, v string")


def components(edges: DataFrame) -> DataFrame:
    """fp and root (the smallest fp of its component) of all that edges (u, v) join, by alternating large and small stars.

    Each round is written to the shared folder.  Minima are taken with partial aggregates and read back from a table, so a hub
    with very many edges is joined like any skewed key that Spark can split.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("v", "u"))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = materialise(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select("v", "m").union(low.select("u", "m"))
        edges = materialise(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct(), "edges")
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def row_hash() -> Column:
    """Tells rows of one doc_id with different texts apart; repeated rows have the same."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS, group: int | None = None, bits: int = 64) -> DataFrame:
    """doc_id, fingerprint (hex digits) and component_id (smallest doc_id that links reach) of every row."""
    made = materialise(fingerprints(docs, width, bits), "fingerprints")
    distinct = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    forest = components(link_forest(distinct.select("fp"), radius, group, bits))
    rooted = materialise(distinct.join(forest, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = materialise(rooted.join(least, "root").select("fp", "component_id"), "named")
    return made.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def alike_links(sets: list[np.ndarray], fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of ``left`` x ``right`` (row numbers; the same array for all pairs of it) whose sets have
    a Jaccard similarity of ``alike`` or more, as (node, root).

    Pairs within the radius are tried nearest first until their ends are joined or they fail; none within it is left out.
    """
    size, forest = np.array([len(x) for x in sets], np.int64), _Forest(len(sets))

    def holds(u: int, v: int) -> bool:
        common = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
        return common / max(1, len(sets[u]) + len(sets[v]) - common) >= alike

    for m in range(0, len(left), 128):
        i, j = _near(fps[left[m : m + 128]], fps[right], radius)
        i, j = left[i + m], right[j]
        apart = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64)
        fit = np.minimum(size[i], size[j]) >= alike * np.maximum(size[i], size[j]) - 1e-6
        if left is right:
            fit &= i < j
        order = np.argsort(apart[fit], kind="stable")
        i, j = i[fit][order], j[fit][order]
        while len(i):
            a, b = forest.parent[i], forest.parent[j]
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            _, first = np.unique(np.maximum(a, b), return_index=True)
            good = np.array([holds(u, v) for u, v in zip(i[first], j[first], strict=True)], bool)
            forest.add(i[first][good], j[first][good])
            forest.settle()
            i, j = np.delete(i, first), np.delete(j, first)
    child = np.flatnonzero(forest.parent != np.arange(len(sets)))
    return child, forest.parent[child]


def alike_components(docs: DataFrame, width: int, alike: float, bits: int, radius: int, group: int | None = None, part: tuple[int, int] = PART) -> DataFrame:
    """doc_id, row, component_id (smallest doc_id that links reach) and kept_row (the row that stands for the component: of
    rows with that id, the one of the smallest hash) of every row; texts are linked if the Jaccard similarity of their sets of
    shingles is ``alike`` or more.

    Texts of equal sets are one node.  Components of near fingerprints hold all candidates; the texts of those with two nodes
    or more are compared in parts of bounded size, one task for each pair of parts.
    """
    kind, row = docs.schema["doc_id"].dataType.simpleString(), row_hash().alias("row")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in slices(batches):
            sets = [np.unique(shingles(t, width)) for t in piece["text"]]
            yield pd.DataFrame({"doc_id": piece["doc_id"], "row": piece["row"], "node": [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], "fp": [_folded(x, bits) for x in sets], "size": [len(x) for x in sets]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row, "text")
    made = materialise(rows.mapInPandas(make, "doc_id string, row long, node string, fp string, size long").withColumn("doc_id", F.col("doc_id").cast(kind)), "shingles")
    nodes = materialise(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first"), F.min("row").alias("row"), F.min("size").alias("size")), "nodes")
    fps = materialise(nodes.select("fp", size_band(F.col("size"), alike).alias("band")).distinct(), "distinct")
    forest = components(link_forest(fps, radius, group, bits, SIZES[0]))
    rooted = materialise(nodes.join(forest, "fp", "left").select("node", "fp", "row", "size", F.coalesce("root", "fp").alias("root")), "rooted")
    return confirmed(docs, made, nodes, rooted, width, alike, radius, part).select("doc_id", "row", "component_id", "kept_row")


def confirmed(docs: DataFrame, made: DataFrame, nodes: DataFrame, rooted: DataFrame, width: int, alike: float, radius: int, part: tuple[int, int] = PART) -> DataFrame:
    """The rows of ``made`` (with node and row) with component_id and kept_row, of links that hold on full sets.

    ``nodes`` has node, first (doc_id and row) and ``rooted`` node, fp, row, size and root, the candidates' component: its texts
    are compared with each other, in parts of bounded size.
    """
    row = row_hash().alias("row")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / part[0]), F.ceil(F.sum("size") / part[1]))
    several = rooted.groupBy("root").agg(parts.cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    candidates = materialise(rooted.join(several, "root").select("row", "root", "node", "fp", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int").alias("g"), "parts"), "candidates")
    texts = docs.select(row, "text").join(candidates.hint("merge"), "row").dropDuplicates(["row"])
    pairs = texts.select("root", "node", "fp", "text", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("h")).select("root", F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q"), "g", "node", "fp", "text")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        side, p, q = pdf["g"].to_numpy(), pdf["p"].iloc[0], pdf["q"].iloc[0]
        left = np.flatnonzero(side == p)
        right = left if p == q else np.flatnonzero(side == q)
        sets = [np.unique(shingles(t, width)) for t in pdf["text"]]
        u, v = alike_links(sets, _numbers(pdf["fp"]), left, right, radius, alike)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"u": node[u], "v": node[v]}).astype(str)

    joined = components(pairs.groupBy("root", "p", "q").applyInPandas(verify, "u string, v string")).withColumnRenamed("fp", "node")
    named = materialise(nodes.join(joined, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "verified")
    least = materialise(named.groupBy("root").agg(F.min("first").alias("first")), "least")
    of = named.drop("first").join(least, "root").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept_row"))
    return made.join(of, "node")


def keep_one_alike(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of texts that share enough shingles, all columns as they are: that of its smallest doc_id; of
    several texts under that id, one.  Of repeated rows one stays.

    Rows without an id are in no component that has a name; they are all kept.
    """
    named = alike_components(docs, **options)
    kept = materialise(named.where("doc_id = component_id and row = kept_row").groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")), "kept")
    held = free_name(docs.columns, "row")
    rows = docs.where("doc_id is not null").withColumn(held, row_hash())
    # The rows that stay grow with the table, so they are merged, not broadcast; rows that are repeated are few or none.
    stay = lambda n: kept.where(n).select("doc_id", F.col("row").alias(held))
    once = rows.join(stay("n = 1").hint("merge"), ["doc_id", held], "left_semi")
    again = rows.join(stay("n > 1"), ["doc_id", held], "left_semi").dropDuplicates(["doc_id", held])
    return once.unionByName(again).drop(held).unionByName(docs.where("doc_id is null")).select(*docs.columns)
