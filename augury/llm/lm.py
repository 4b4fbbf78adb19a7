"""Language-model scoring by context-tree weighting.

Bytes are split into eight binary decisions.  Every decision has a tree over the bytes before it, ``depth`` deep; each node has a
Krichevsky-Trofimov estimate of its counts, and a node's block probability is the mean of its own estimate's and the product of
its children's.  The posterior of these weights mixes the estimates at all depths, which gives the code length of a byte.

The tree holds every context of the training bytes, so it grows with them and is never in one place.  Tasks count runs of
``depth`` + 1 bytes, Spark sums them, and the nodes whose last ``TOP`` bytes agree are one group: it folds its part of the tree
from the leaves to the probability that it hands up.  The 256 sums of one last byte are folded on the driver, and with what
comes down from there each group gives the code length of its runs.

Beside it stands a unigram base model with add-one smoothing over all words.  Texts are dealt, where they are read, into blocks of
bounded size; a block's distinct words and runs are sent to be summed, and their counts and code lengths sent back to it.

Texts are scored with A-Z in lower case.  Defined results: null texts count as empty, which have the end of the text alone;
a null id counts as the empty text in the split; very long texts are scored whole (a block then holds one); repeated rows are
scored each; without training rows all counts are 0 and every byte has probability 1/256.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from augury.llm.common import materialise, remainder, slices

DEPTH = 4
TOP = 2  # bytes of context that the runs of a group share
BLOCK_CHARS = 16_000_000
END = b"\xff"  # no byte of UTF-8: stands before and after a text
_CHUNK_RUNS = 8192  # runs of a group whose nodes are folded at once
_LN2 = np.log(2)
_TOP_MASK = (1 << 8 * TOP) - 1


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def run_keys(raws: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``depth`` bytes of context and one more, packed with the last byte lowest, of each byte of the texts and of
    their ends; and the number of runs of each text."""
    data = np.frombuffer(b"".join(END * depth + raw + END for raw in raws), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(raw) + 1 for raw in raws), np.int64, len(raws))
    key = np.zeros(max(0, len(data) - depth), np.int64)
    for k in range(depth + 1):
        key = (key << 8) | data[k : len(data) - depth + k]
    own = np.ones(len(key) + depth, bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    for k in range(depth):
        own[starts + k] = False  # bytes of the context before a text
    return key[own[depth:]], sizes


def _hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words)).view(np.int64)


class _Block:
    """Texts of a block, and its distinct words and runs with their training counts."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.ids: list[str | None] = []
        self.train: list[int] = []
        self.raws: list[bytes] = []
        self.words: Counter[bytes] = Counter()
        self.runs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, piece: pd.DataFrame) -> None:
        raws, train = [_raw(t) for t in piece["text"]], piece["train"].tolist()
        self.ids += piece["doc_id"].tolist()
        self.train += train
        self.raws += raws
        self.size += sum(map(len, raws)) + len(raws)
        for learned in (1, 0):
            part = [raw for raw, t in zip(raws, train, strict=True) if t == learned]
            words = b"\n".join(part).split()
            self.words.update(words if learned else dict.fromkeys(words, 0))
            key, n = np.unique(run_keys(part, self.depth)[0], return_counts=True)
            self.runs, where = np.unique(np.concatenate([self.runs, key]), return_inverse=True)
            self.times = np.bincount(where, np.concatenate([self.times, n * learned]), len(self.runs)).astype(np.int64)

    def rows(self, number: int) -> Iterator[pd.DataFrame]:
        """The packed texts, then a row for each word and run."""
        packed = zstandard.compress(END.join(self.raws), 3)
        yield pd.DataFrame({"block": [number], "kind": [0], "key": [0], "n": [len(self.raws)], "ids": [self.ids], "train": [self.train], "packed": [packed]})
        for kind, key, n in ((1, _hashes(list(self.words)), np.fromiter(self.words.values(), np.int64, len(self.words))), (2, self.runs, self.times)):
            for m in range(0, len(key), 500_000):
                part = slice(m, m + 500_000)
                yield pd.DataFrame({"block": number, "kind": kind, "key": key[part], "n": n[part], "ids": None, "train": None, "packed": None})


def blocks(docs: DataFrame, depth: int, block_chars: int) -> DataFrame:
    """Texts in blocks of about ``block_chars`` bytes, made where they are read: block, kind (0 texts, 1 word, 2 run), key, n
    (training count), and of the texts ids, train and packed (compressed, an END between two)."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count, held = TaskContext.get().partitionId(), 0, _Block(depth)
        for piece in slices(batches, most=2_000_000):
            held.add(piece)
            if held.size >= block_chars:
                yield from held.rows((task << 32) + count)
                count, held = count + 1, _Block(depth)
        if held.raws:
            yield from held.rows((task << 32) + count)

    return docs.select("doc_id", "text", "train").mapInPandas(deal, "block long, kind byte, key long, n long, ids array<string>, train array<int>, packed binary")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x of 0.5 or more, by Stirling's series at x + 8."""
    y, below = x + 8.0, np.ones_like(x)
    for k in range(8):
        below *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(below)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    out = np.zeros(zeros.shape)
    seen = (zeros + ones) > 0
    a, b = zeros[seen], ones[seen]
    out[seen] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)
    return out


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions (numbered as a heap from 1) from counts of 256 bytes, by row."""
    zeros, ones, level = np.empty((len(counts), 255)), np.empty((len(counts), 255)), counts
    for k in range(7, -1, -1):
        place = slice((1 << k) - 1, (2 << k) - 1)
        zeros[:, place], ones[:, place] = level[:, 0::2], level[:, 1::2]
        level = level[:, 0::2] + level[:, 1::2]
    return zeros, ones


class _Nodes:
    """Nodes with their decisions: ``below`` is the log of the block probability of the tree from a node on, ``inside`` that of
    its children (None for leaves)."""

    def __init__(self, counts: np.ndarray, inside: np.ndarray | None):
        self.counts = counts
        self.zeros, self.ones = _decisions(counts)
        self.own = _log_kt(self.zeros, self.ones)
        self.below = self.own if inside is None else np.logaddexp(self.own, inside) - _LN2
        self.leaf = inside is None

    def mixed(self, given: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the estimates down to these nodes give to a one, and the weight that is left for deeper ones."""
        weight = 1.0 if self.leaf else np.exp(self.own - _LN2 - self.below)
        return given + left * weight * (self.ones + 0.5) / (self.zeros + self.ones + 1), left * (1 - weight)


def _sum_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their owner."""
    order = np.argsort(owner, kind="stable")
    out, held = np.zeros((n, values.shape[1])), owner[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(held) != 0])) if len(held) else np.zeros(0, np.int64)
    if len(first):
        out[held[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _levels(runs: np.ndarray, n: np.ndarray, first: int, depth: int) -> list[tuple[_Nodes, np.ndarray, np.ndarray]]:
    """Of each depth from ``first`` on: the nodes, each node's parent in the level above, and each run's node."""
    contexts, rows = [], []
    for d in range(first, depth + 1):
        context, row = np.unique((runs >> 8) & ((1 << 8 * d) - 1), return_inverse=True)
        contexts.append(context)
        rows.append(row)
    out: list = []
    for k in range(depth - first, -1, -1):
        size = len(contexts[k])
        counts = np.bincount(rows[k] * 256 + (runs & 255), n, size * 256).reshape(-1, 256)
        inside = _sum_by(out[-1][0].below, out[-1][1], size) if out else None
        parent = np.searchsorted(contexts[k - 1], contexts[k] & ((1 << 8 * (first + k - 1)) - 1)) if k else np.zeros(size, np.int64)
        out.append((_Nodes(counts, inside), parent, rows[k]))
    return out[::-1]


def _chunks(runs: np.ndarray, top: int) -> Iterator[np.ndarray]:
    """Places of the runs of whole contexts one byte longer than ``top``, some thousand at a time."""
    context = (runs >> 8) & ((1 << 8 * (top + 1)) - 1)
    order = np.argsort(context, kind="stable")
    held, begin = context[order], 0
    while begin < len(order):
        stop = min(len(order), begin + _CHUNK_RUNS)
        stop = int(np.searchsorted(held, held[stop - 1], "right"))
        yield order[begin:stop]
        begin = stop


def fold(runs: np.ndarray, n: np.ndarray, depth: int, top: int) -> _Nodes:
    """The node that all runs have at depth ``top``."""
    counts = np.bincount(runs & 255, n, 256)[None, :]
    if depth == top:
        return _Nodes(counts, None)
    return _Nodes(counts, sum(_levels(runs[c], n[c], top + 1, depth)[0][0].below.sum(0, keepdims=True) for c in _chunks(runs, top)))


_HEAP = (np.arange(256)[:, None] + 256) >> np.arange(8, 0, -1)[None, :]  # the eight decisions of a byte
_BIT = (np.arange(256)[:, None] >> np.arange(7, -1, -1)[None, :]) & 1


def _lengths(p: np.ndarray, row: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """-log10 of the probability of bytes, from those of a one in each decision."""
    p = p[row[:, None], _HEAP[byte] - 1]
    return -np.log10(np.where(_BIT[byte], p, 1 - p)).sum(1)


def code_lengths(runs: np.ndarray, n: np.ndarray, given: np.ndarray, left: np.ndarray, depth: int, top: int) -> np.ndarray:
    """Code length of each run of a group, from what the nodes above ``top`` give and leave."""
    given, left = fold(runs, n, depth, top).mixed(given[None, :], left[None, :])
    if depth == top:
        return _lengths(given, np.zeros(len(runs), np.int64), runs & 255)
    out = np.zeros(len(runs))
    for chunk in _chunks(runs, top):
        g, rest = given, left
        for nodes, parent, row in _levels(runs[chunk], n[chunk], top + 1, depth):
            g, rest = nodes.mixed(g[parent], rest[parent])
        out[chunk] = _lengths(g, row, runs[chunk] & 255)
    return out


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs and counts of each group, of rows that come sorted by group; one group is held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pdf in batches:
        key, n = pdf["key"].to_numpy(), pdf["n"].to_numpy(float)
        cut = np.flatnonzero(np.diff(key >> 8 & _TOP_MASK)) + 1
        for part in zip(np.split(key, cut), np.split(n, cut), strict=True):
            if held and len(part[0]) and (held[0][0][0] ^ part[0][0]) >> 8 & _TOP_MASK:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
            if len(part[0]):
                held.append(part)
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def run_codes(runs: DataFrame, depth: int) -> DataFrame:
    """key and code (code length of the last byte, log10) of all runs (key, n), which are trained on their counts."""
    # Runs of a group meet in one task and follow each other there.
    grouped = runs.withColumn("near", F.expr(f"(key div 256) & {_TOP_MASK}")).repartition("near").sortWithinPartitions("near").select("key", "n")

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs, n in _groups(batches):
            node = fold(runs, n, depth, TOP)
            yield pd.DataFrame({"last": [int(runs[0] >> 8 & 255)], "counts": [node.counts.tobytes()], "below": [node.below.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c: np.stack([np.frombuffer(x) for x in pdf[c]]).sum(0, keepdims=True)
        node = _Nodes(read("counts"), read("below"))
        return pd.DataFrame({"last": [int(pdf["last"].iloc[0])], "counts": [node.counts.tobytes()], "below": [node.below.tobytes()], "inside": [read("below").tobytes()]})

    handed = grouped.mapInPandas(up, "last int, counts binary, below binary")
    # A group of one last byte has 256 nodes at most, and the driver takes 256 rows of some kilobytes at most.
    lasts = handed.groupBy("last").applyInPandas(merge, "last int, counts binary, below binary, inside binary").collect()
    given, left = np.full((256, 255), 0.0), np.full((256, 255), 1.0)
    if lasts:
        read = lambda c: np.stack([np.frombuffer(r[c]) for r in lasts])
        root = _Nodes(read("counts").sum(0, keepdims=True), read("below").sum(0, keepdims=True))
        at = [r["last"] for r in lasts]
        given[at], left[at] = _Nodes(read("counts"), read("inside")).mixed(*root.mixed(given[:1], left[:1]))
    shared = runs.sparkSession.sparkContext.broadcast((given, left))

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs, n in _groups(batches):
            last = int(runs[0] >> 8 & 255)
            yield pd.DataFrame({"key": runs, "code": code_lengths(runs, n, shared.value[0][last], shared.value[1][last], depth, TOP).astype(np.float32)})

    return grouped.mapInPandas(down, "key long, code float")


class _Finder:
    """Places of runs in a sorted array that holds all of them, one byte after the other."""

    def __init__(self, known: np.ndarray, depth: int):
        self.steps, above = [], np.zeros(1, np.int64)
        for k in range(depth, -1, -1):
            prefix = np.unique(known >> 8 * k)
            table = np.zeros(len(above) * 256, np.int32)
            table[np.searchsorted(above, prefix >> 8) * 256 + (prefix & 255)] = np.arange(len(prefix))
            self.steps.append((8 * k, table))
            above = prefix

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.zeros(len(keys), np.int64)
        for shift, table in self.steps:
            at = table[at * 256 + (keys >> shift & 255)]
            at = at.astype(np.int64)
        return at


def _score_block(own: pd.DataFrame, facts: pd.DataFrame, depth: int, ends: int) -> pd.DataFrame:
    """The sums of one block's texts, from its words' counts (those that other blocks add to) and its runs' code lengths."""
    raws = zstandard.decompress(bytes(own["packed"].iloc[0]), max_output_size=1 << 31).split(END)
    ids, train = list(own["ids"].iloc[0]), np.array(own["train"].iloc[0], np.int64)
    kind, key = facts["kind"].to_numpy(), facts["key"].to_numpy()
    order = np.argsort(key[kind == 2])
    known, code = key[kind == 2][order], facts["code"].to_numpy(float)[kind == 2][order]
    finder, index, numbers, score, begin = _Finder(known, depth), {}, [], [], 0
    while begin < len(raws):
        stop, size = begin, 0
        while stop < len(raws) and (stop == begin or size + len(raws[stop]) < 2_000_000):
            size += len(raws[stop])
            stop += 1
        keys, sizes = run_keys(raws[begin:stop], depth)
        score.append(-np.add.reduceat(code[finder.find(keys)], np.cumsum(sizes) - sizes))
        numbers += [np.array([index.setdefault(w, len(index)) for w in raw.split()], np.int32) for raw in raws[begin:stop]]
        begin = stop
    learned = [x for x, t in zip(numbers, train, strict=True) if t]
    times = np.bincount(np.concatenate(learned), minlength=len(index)) if learned else np.zeros(len(index), np.int64)
    order = np.argsort(key[kind == 1])
    words, counts = key[kind == 1][order], facts["c"].to_numpy()[kind == 1][order]
    if len(words) and len(index):
        h = _hashes(list(index))
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        times = np.where(words[at] == h, counts[at], times)
    log = np.log10(times + 1.0)
    return pd.DataFrame({
        "doc_id": ids, "train": train, "n_tokens": np.array([len(x) + 1 for x in numbers], np.int64), "n_known": np.array([int((times[x] > 0).sum()) + int(ends > 0) for x in numbers], np.int64),
        "logs": np.array([float(log[x].sum() + np.log10(ends + 1.0)) for x in numbers], float), "score": np.concatenate(score), "n_bytes": np.array([len(raw) + 1 for raw in raws], np.int64),
    })


def score_language(docs: DataFrame, folds: int = 7, held_out: int = 2, depth: int = DEPTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of ``docs``."""
    if depth < TOP:
        raise ValueError(f"contexts of {TOP} bytes or more are needed")
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = remainder(F.col("doc_id"), folds)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (part != held_out).cast("int").alias("train"))
    dealt = materialise(blocks(rows, depth, block_chars), "blocks")
    ends = dealt.where("kind = 0").agg(F.sum(F.aggregate("train", F.lit(0), lambda a, x: a + x))).first()[0] or 0

    # Rows of a word meet once, for their sum and for its way back; a word has a row for each block at most, and they are streamed.
    words = dealt.where("kind = 1").select("block", "key", "n").repartition("key")
    whole = words.groupBy("key").agg(F.sum("n").alias("c"), F.min("block").alias("first"))
    seen = Observation()
    counted = words.join(whole.hint("merge"), "key").observe(seen, F.sum("n").alias("n"), F.count_if((F.col("block") == F.col("first")) & (F.col("c") > 0)).alias("v"))
    # A word that occurs in one block alone is counted there, not sent.
    words = materialise(counted.where("c > n").select("block", F.lit(1).cast("byte").alias("kind"), "key", "c", F.lit(None).cast("float").alias("code")), "word-counts")
    n, v = (seen.get["n"] or 0) + ends, (seen.get["v"] or 0) + (ends > 0)

    runs = dealt.where("kind = 2").select("block", "key", "n")
    codes = materialise(run_codes(materialise(runs.groupBy("key").agg(F.sum("n").alias("n")), "runs"), depth), "codes")
    back = runs.select("block", "key").join(codes, "key").select("block", F.lit(2).cast("byte").alias("kind"), "key", F.lit(0).cast("long").alias("c"), "code")
    facts = words.unionByName(back)

    texts = dealt.where("kind = 0").select("block", "ids", "train", "packed")
    scored = texts.groupBy("block").cogroup(facts.groupBy("block")).applyInPandas(lambda own, known: _score_block(own, known, depth, ends), "doc_id string, train long, n_tokens long, n_known long, logs double, score double, n_bytes long")
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), (F.col("train") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
