"""Prefix trie, MinHash near-duplicates and ranked search against brute-force versions, with edge rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from compare import DATA, compare, connect
from pyspark.sql import functions as F

from augury.llm import minhash, queries, search, trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_minhash", "op13_search"])
def test_against_sql(spark, name):
    assert compare(spark, connect(DATA), DATA, queries.queries()[name], queries.oracle_sql()[name]) is None


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members, children, totals, out = defaultdict(list), defaultdict(list), {}, set()
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[node]]
        own_words = len(words(node[-1][1])) if node else 0
        totals[node] = sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[node]) - 1) * own_words
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_trie(spark):
    rng, rows = random.Random(3), []
    for c in [*range(-45, 130), *range(10**12, 10**12 + 30)]:
        for t in rng.sample(range(9), rng.randrange(6)):
            rows.append((c, None if t == 0 else t, rng.choice(["user", None, ""]), rng.choice(["a", "a b", "", None, "x y  z"])))
    rows += [(None, 1, "user", "lost"), *[(60, t, "user", f"turn {t} of a long one") for t in range(20, 400)]]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("mine") for c in ("depth", "a", "words", "key")})
    want = brute_trie(rows)
    for shard, most in ((1024, 10**6), (4, 20)):  # the second spills and has several ranks
        got = [tuple(r) for r in trie.prefix_trie(df, shard, most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert trie.prefix_trie(df.where("false")).count() == 0
    again = trie.prefix_trie(spark.createDataFrame([(7, 1, "u", "x y")] * 5 + [(0, 1, None, None)], CONVERSATIONS))
    assert {(r["depth"], r["n_convs"]) for r in again.collect()} >= {(0, 2)}


def test_queue_gives_messages_in_order():
    rng, queue = np.random.default_rng(1), trie.SpillingQueue(50)
    keys = trie._keys(rng.integers(0, 9, 400), rng.integers(-5, 5, 400), rng.integers(-(2**62), 2**62, 400))
    for k in range(0, 400, 7):
        rows = np.zeros(len(keys[k : k + 7]), trie.MESSAGE)
        rows["key"], rows["leaves"] = keys[k : k + 7], np.arange(k, k + len(rows))
        queue.push(rows)
    assert queue.runs
    seen = []
    for last in np.sort(keys)[9::10]:
        got = queue.pop(last)
        assert (got["key"] <= last).all()
        seen += got["leaves"].tolist()
    assert sorted(seen) == list(range(400)) and not queue.runs


def brute_alike(rows):
    """n_shingles and smallest id of the component of each row (id, text)."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOW))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            root = find(k)
            least[root] = i if least[root] is None else min(least[root], i)
    return Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def near_rows():
    rng, rows = random.Random(5), []
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40, 90]))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text) if g % 3 else " ".join([*text, *passage]).upper())
    return [(i, t) for i, t in enumerate(rows)]


def test_minhash(spark, edges, nothing):
    rows = near_rows() + [(r["doc_id"], r["text"]) for r in edges.collect()] + [(None, "w1 w2"), (None, "w1 w2"), (950001, "w1 w2"), (950002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("node", "row", "sig", "fp", "size", "kept", "root")})
    want = brute_alike(rows)
    for options in ({}, {"region": 3, "part": 4}, {"region": 2, "rounds": ((1, 12), (2, 20))}):
        got = Counter(tuple(r) for r in minhash.near_duplicates(df, **options).collect())
        assert got == want
    assert minhash.near_duplicates(nothing.select("doc_id", "text")).count() == 0


def test_neighbours_carry_regions_over_batches():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"key": np.sort(rng.integers(0, 40, 200)), "id": np.arange(200), "comp": np.arange(200)}).assign(**{s: rng.integers(0, 2, 200) for s in minhash._SKETCH})
    joined = lambda parts: sum(len(p) for p in minhash.neighbours(iter(parts), 0))
    assert joined([rows]) == joined([rows.iloc[k : k + 7].reset_index(drop=True) for k in range(0, 200, 7)]) > 0


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_search(docs, items):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(w for c in counts for w in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for (i, _), c in zip(docs, counts, strict=True):
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, lost, i) in enumerate(sorted(scores)[:10], 1):
            out[item, rank, None if lost else i, -s] += 1
    return out


def test_search(spark, docs, edges, nothing, table, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(970000 + k % 7, "rare gem ähnlich " + "de la " * (k % 5)) for k in range(40)]  # ties and repeated rows
    rng = random.Random(4)
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    items += [(9001, "Rare GEM rare"), (9002, None), (9003, " ,.!"), (9004, "zzzunseen"), (None, "de LA gem"), (9001, "Rare GEM rare"), (9005, "word1 and ähnlich 日本語")]
    items += [(9100 + k, " ".join(rng.sample(terms(rows[k][1]) or ["x"], 1))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("shard", "term", "docs", "n", "score", "rank")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("idx", F.lit("mine"))
    want = brute_search(rows, [x for x in items if x[1] is not None])
    for bundle, shares in ((256, (4096, 256, 16)), (5, (50, 9, 2))):
        monkeypatch.setattr(search, "BUNDLE", bundle)
        monkeypatch.setattr(search, "SHARES", shares)
        assert Counter(tuple(r) for r in search.search(df, asked).collect()) == want
    assert search.search(nothing, asked).count() == 0 == search.search(df, asked.where("false")).count()
    named = search.search(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), asked, 1)
    assert named.where("rank > 1").count() == 0 < named.count()
