"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with edge rows and empty tables."""

import functools
import hmac
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from augury.llm import decontam, fertility, langid, licenses, lm, mixing, pii, quality, simhash, toxicity

ASCII_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOW))


def remainder(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % n


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("module, field", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, field, nothing):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    op = module.toxicity if module is toxicity else module.quality
    got = op(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert [remainder(i, 5) == 0 for i in got["doc_id"]] == got["held_out"].tolist()
    seen = got.merge(labels.toPandas(), on="doc_id")
    seen = seen[seen["held_out"]]
    assert (seen["predicted"] == seen[field]).mean() > 0.9


def test_classifier_edges(spark, table, edges, nothing):
    labels = table("labels").union(spark.createDataFrame([(None, 1, 1), (900001, None, None), (900006, 0, 1), (900006, 1, 0)], "doc_id long, quality int, toxic int"))
    both = table("documents").unionByName(edges).withColumn("score", F.lit("mine"))
    for op in (toxicity.toxicity, quality.quality):
        got = op(both, labels).toPandas()
        assert len(got) == both.count() and got["score"].notna().all()
        twice = got[got["doc_id"] == 900006]["score"]
        assert len(twice) == 2 and twice.nunique() == 1
        assert op(nothing, labels).count() == 0
        assert op(edges, labels.where("false")).count() == edges.count()
    assert (toxicity.toxicity(both, labels).where("doc_id in (900001, 900002, 900003)").toPandas()["predicted"] == 0).all()
    named = [df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))) for df in (both, labels)]
    for op in (toxicity.toxicity, quality.quality):
        assert op(*named).where("score > 0").count() == both.count()


def test_labels_of_held_out_rows_are_not_learned(spark, table):
    docs, labels = table("documents"), table("labels")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x).orderBy("doc_id").toPandas()["score"] for x in (labels, turned))
    assert np.array_equal(a, b)


def brute_kneser_ney(counts, contexts, word):
    """Interpolated Kneser-Ney by the textbook: own discounted counts, then continuation counts of both classes, then any word."""

    def level(ns, lower):
        n = [sum(v == k for v in ns.values()) for k in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        d = [0] + [min(max(k - (k + 1) * y * n[k + 1] / max(1, n[k]), 0.1), k - 0.05) for k in (1, 2, 3)]
        total = sum(ns.values())
        return max(ns.get(word, 0) - d[min(3, ns.get(word, 0))], 0) / total + sum(d[min(3, v)] for v in ns.values()) / total * lower

    return level(counts, level({w: len(x) for w, x in contexts.items()}, 1 / (len(contexts) + 1)))


def test_toxicity_models_are_kneser_ney_and_sum_to_one(spark):
    texts = [(1, "vequmo le vequta de vequmo"), (1, "le vequa la vejuno vequmo"), (0, "le moto de la porte"), (0, "la porte le de motu vela"), (0, "vela vela")]
    rows = toxicity.count_words(spark.createDataFrame(texts, "toxic int, text string")).collect()
    own, contexts = [Counter(), Counter()], {}
    for toxic, text in texts:
        own[1 - toxic].update(set(text.split()))
        for before, word in zip(["^", *text.split()], text.split(), strict=False):
            contexts.setdefault(word, set()).add(before)
    assert {r["word"]: (r["t"], r["o"], r["contexts"]) for r in rows} == {w: (own[0][w], own[1][w], len(x)) for w, x in contexts.items()}
    models = toxicity.KneserNey((dict(own[0]), dict(own[1])), {w: len(x) for w, x in contexts.items()})
    for k in (0, 1):
        assert sum(models.chance(k, w) for w in [*contexts, "unseen"]) == pytest.approx(1)
        for word in [*contexts, "unseen"]:
            assert models.chance(k, word) == pytest.approx(brute_kneser_ney(own[k], contexts, word))
    model = toxicity.fit_models(spark.createDataFrame(rows))
    assert model.ratio["vequmo"] == pytest.approx(math.log(models.chance(0, "vequmo") / models.chance(1, "vequmo")))
    # A word of many toxic texts is evidence; one of two texts, nearly all of whose count is discounted, is not.
    many = spark.createDataFrame([(k % 2, f"{'vequmo' if k % 2 else 'moto'} le wort{'abcdefghijkl'[k // 2]}") for k in range(24)], "toxic int, text string")
    model = toxicity.fit_models(toxicity.count_words(many))
    assert model.ratio["vequmo"] > 1 > -1 > model.ratio["moto"] and model.ratio["unseen"] == model.ratio.other
    assert toxicity.evidence(model, "le vequmo de") > (0.0, 0.0) == toxicity.evidence(model, "12 !")


def test_toxic_texts_are_found_and_ordinary_ones_left(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    marks = labels.select("doc_id", "toxic").where("toxic in (0, 1)")
    seen = toxicity.toxicity(docs.join(marks, "doc_id", "left_semi"), labels).where("held_out").join(marks, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p"))
    share = {r["toxic"]: r["p"] for r in seen.collect()}
    assert share[1] >= 0.85 and share[0] <= 0.02


def test_language(docs, nothing):
    got = langid.language_id(docs).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    for i in (900001, 900002, 900003, 900004):
        assert got[got["doc_id"] == i]["lang_pred"].tolist() == ["und"]
    seen = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    seen = seen[seen["held_out"] & (seen["doc_id"] < 900000)]
    assert (seen["lang_pred"] == seen["lang"]).mean() > 0.9
    assert langid.language_id(nothing).count() == 0
    model = langid.train(docs.where("doc_id < 900000"))
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {900001, 900002, 900003, 900004} & {r["doc_id"] for r in kept.collect()}
    strange = docs.limit(1).withColumn("text", F.explode(F.array(*map(F.lit, ["привет как дела сегодня вечером", "aaaaaaa bbbbbbb", "the and of to in is"]))))
    assert [r["text"] for r in langid.keep_identified(strange, model).collect()] == ["the and of to in is"]
    assert langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_copies_have_places_of_their_own(spark):
    docs = spark.range(20_000).selectExpr("7L AS doc_id", "'src' AS source", "'the same row over and over' AS text").unionByName(spark.sql("SELECT 8L AS doc_id, 'src' AS source, 'another' AS text"))
    got = mixing.stream_offsets(docs).toPandas().sort_values("offset")
    assert len(got) == 20_001 and (got["offset"].to_numpy() == got["size"].cumsum().to_numpy() - got["size"].to_numpy()).all()
    sizes = docs.selectExpr("doc_id", "source AS key", "6L AS size", "xxhash64(doc_id) AS place")
    placed = mixing._numbered_copies(sizes, chunk=64).toPandas()
    assert placed.groupby("doc_id").size().to_dict() == {7: 20_000, 8: 1} and placed["place"].nunique() == 20_001
    assert (placed["place"] % 40).value_counts().max() < 2 * 20_000 / 40  # buckets share the copies
    once = sizes.distinct()
    assert sorted(map(tuple, mixing._numbered_copies(once).collect())) == sorted(map(tuple, once.collect()))


def test_mixing(docs, nothing):
    got = mixing.mix(docs, block_words=64).toPandas()
    again = mixing.mix(docs.repartition(3), block_words=64).toPandas()
    order = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), again.sort_values(order).reset_index(drop=True))
    source = pd.DataFrame([(r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.select("doc_id", "source", "text").collect()], columns=["doc_id", "source", "n"])
    assert sorted(got["size"]) == sorted(source["n"])
    sizes = source.assign(source=source["source"].fillna("\U0010ffff")).groupby("source")["n"].sum().sort_index()
    weight, cap, free = np.array([k % 3 + 1 for k in range(len(sizes))], float), 3.0 * sizes.to_numpy(), np.ones(len(sizes), bool)
    target = np.zeros(len(sizes))
    while True:  # brute force: cap, share the excess, again
        target[~free] = cap[~free]
        target[free] = weight[free] * (sizes.sum() - cap[~free].sum()) / weight[free].sum()
        over = free & (target > cap)
        if not over.any():
            break
        free &= ~over
    owner = {None if pd.isna(i) else i: s for i, s in zip(source["doc_id"], source["source"].fillna("\U0010ffff"), strict=True)}
    got["source"] = [owner[None if pd.isna(i) else i] for i in got["doc_id"]]
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first")).sort_index()
    assert by["size"].tolist() == sizes.tolist()
    assert np.allclose(by["target"], target)
    assert (np.abs(by["taken"] - by["target"]) <= 1).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    assert mixing.mix(nothing).count() == 0


def test_mixed_blocks(docs):
    blocks = mixing.mixed_blocks(docs, block_words=64, shard_slots=8).toPandas()
    assert not blocks.duplicated(["shard", "slot"]).any()
    assert (blocks["words"] == [sum(p["n_words"] for p in ps) for ps in blocks["pieces"]]).all()
    taken = Counter()
    for ps in blocks["pieces"]:
        for p in ps:
            taken[p["doc_id"]] += p["n_words"]
    got = mixing.mix(docs, block_words=64, shard_slots=8).toPandas().fillna({"doc_id": -1})
    digest = got.groupby("doc_id")["taken"].sum()
    assert {(-1 if k is None else k): v for k, v in taken.items()} == {k: v for k, v in digest.items() if v}
    # The draw decides: a document's shards are those of the blocks that hold it, and the counts by shard are its slots.
    shards = Counter(i for i, _ in {(p["doc_id"], shard) for shard, ps in zip(blocks["shard"], blocks["pieces"], strict=True) for p in ps})
    once = got[~got["doc_id"].isin([-1, 900006])]
    assert {i: n for i, n in zip(once["doc_id"], once["n_shards"], strict=True) if n} == {i: n for i, n in shards.items() if i is not None and i != 900006}
    _, _, slots, _ = mixing._plan(docs, mixing.WEIGHTS, mixing.MOST, 64, 8, "mix")
    drawn = mixing.shard_counts(slots).toPandas()
    assert drawn.groupby("shard")["n"].sum().iloc[:-1].eq(8).all() and drawn["n"].sum() == len(blocks)


def test_draw_is_like_a_multinomial(docs):
    """Slots of a source in a shard: mean and variance of the draw given the totals."""
    _, _, slots, _ = mixing._plan(docs, mixing.WEIGHTS, mixing.MOST, 16, 100, "mix")
    table = mixing.shard_counts(slots).toPandas().pivot_table(index="shard", columns="key", values="n", fill_value=0)
    full = table[table.sum(1) == 100]
    for key in table.columns:
        share = table[key].sum() / table.to_numpy().sum()
        assert abs(full[key].mean() - 100 * share) < 3
        assert 0.5 < (full[key].var() + 1) / (100 * share * (1 - share) + 1) < 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000])
def test_permutation(spark, n):
    moved = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), "k", F.lit(3)).alias("v")).toPandas()["v"]
    assert sorted(moved) == list(range(n))


def test_fertility(docs, nothing):
    got = fertility.quality_rules(docs).toPandas()
    want = Counter()
    for i, text in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = set()
        for k in range(len(w) - 2):
            if windows[tuple(w[k : k + 3])] > 1:
                inside |= {k, k + 1, k + 2}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        n = len(w)
        want[(i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)] += 1
    have = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples())
    assert have == want
    assert not (got["kept"] & got["base_failed"]).any()
    assert got[~got["base_failed"]]["kept"].mean() > 0.9
    assert fertility.quality_rules(nothing).count() == 0


def test_fertility_bands_reject_junk(spark):
    """Planted junk is outside the bands that the corpus gives, its texts are inside."""
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars > 600").limit(300)
    codes = " ".join(f"{k * 7919 % 99991:x}-{k * 104729 % 9973:x}_{k % 13}q" for k in range(200))
    signs = " ".join("".join(chr(0x2800 + (k * j) % 200) for j in range(3, 9)) for k in range(120))
    draw = random.Random(1)
    glue = " ".join("".join(draw.choices("qxzjkvwy", k=40)) for _ in range(80))
    junk = [(990001, codes), (990002, signs), (990003, glue)]
    docs = good.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, "en") for i, t in junk], "doc_id long, text string, lang string"))
    got = fertility.quality_rules(docs).toPandas().set_index("doc_id")
    assert not got.loc[[i for i, _ in junk], "base_failed"].any() and not got.loc[[i for i, _ in junk], "kept"].any()
    clean = got[(got.index < 990000) & ~got["base_failed"]]
    assert clean["kept"].mean() > 0.9
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert clean[clean.index.map(labels) == 1]["kept"].mean() > 0.98
    few = fertility.quality_rules(docs, least=1000).toPandas()  # no group has as many texts: no bands
    assert (few["kept"] == ~few["base_failed"]).all()


def test_bands_are_quartile_fences(spark):
    rows = [("latin", False, float(v), 0.0, 5.0) for v in range(1, 102)] + [("latin", True, 1e6, 1.0, 0.0)]
    band = fertility.bands(spark.createDataFrame(rows, "script string, base_failed boolean, chars_per_token double, byte_share double, token_entropy double"), ["script"]).first()["band"]
    assert tuple(band["chars_per_token"]) == (26 - 3 * 50, 76 + 3 * 50) and tuple(band["byte_share"]) == pytest.approx((-0.03, 0.03)) and tuple(band["token_entropy"]) == pytest.approx((4.85, 5.15))


def test_pseudonyms(spark, docs, nothing):
    values = ["jo.doe@example.org", "JO.DOE@EXAMPLE.ORG", "4785380592391139", "4785 3805 9239 1139", "152.143.123.131", "+1 (372) 555-7739", "2024-02-29", "29/02/2024", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "123-45-6789", "12/31/2024", "2024-12-31T10:00"]
    not_valid = ["4785380592391138", "300.1.1.1", "2023-02-29", "000-12-3456", "1.2.3", "2017", "12345", "13/32/2024", "version 1.2.3.4", "v1.2.3.4"]
    plain = spark.createDataFrame([(k, f"see {v}, and {v}!") for k, v in enumerate(values + not_valid)], "doc_id long, text string")
    moved = {r["doc_id"]: r for r in pii.pseudonymise(plain, "key zero").collect()}
    for k, v in enumerate(values):
        a, b = re.fullmatch(r"see (.*), and (.*)!", moved[k]["text"]).groups()
        assert a == b != v and moved[k]["pii_found"] == 2
        if "." not in v or "@" in v:
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", a.split("@")[0]))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v.split("@")[0]))) or len(v) == 40
    assert moved[0]["text"].upper().replace("SEE ", "see ").replace(", AND ", ", and ") == moved[1]["text"]
    digits = [int(c) for c in re.sub(r"\D", "", moved[2]["text"])[:16]]
    assert sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1])) % 10 == 0
    for k, v in enumerate(not_valid, len(values)):
        assert moved[k]["text"] == f"see {v}, and {v}!"
    # One date in four forms is one date still, and one that can be read in two orders keeps both readings possible.
    forms = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(["12/31/2024", "31/12/2024", "31.12.2024", "2024-12-31", "03/04/2024"])), "doc_id long, text string"), "k").collect()}
    year, month, day = forms[3].split("-")
    assert forms[0] == f"{month}/{day}/{year}" and forms[1] == f"{day}/{month}/{year}" and forms[2] == f"{day}.{month}.{year}" and int(day) > 12
    assert max(map(int, forms[4].split("/")[:2])) <= 12
    both = docs.unionByName(plain, allowMissingColumns=True)
    there = pii.pseudonymise(both, "key one")
    assert there.columns == [*both.columns, "pii_found_2"] and there.where("doc_id < 100 and pii_found <> 'mine'").count() == 0
    back = pii.pseudonymise(there, "key one", inverse=True)
    assert Counter(rows_of(back)) == Counter(rows_of(both))
    assert pii.pseudonymise(nothing, "k").count() == 0 and set(docs.columns) < set(there.columns)
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(plain, "key two").collect()}
    assert other[2] != moved[2]["text"]
    with pytest.raises((TypeError, ValueError)):
        pii.pseudonymise(plain, "")
    shown = there._jdf.queryExecution().toString()
    assert "key one" not in shown and "key one".encode().hex() not in shown.lower() and pii.pads("key one")[0].hex() not in shown.lower()
    one = spark.range(1).select(pii.keyed_hash(tuple(map(F.lit, pii.pads("k" * 200))), F.lit("a"), F.lit("b")).alias("h")).first()["h"]
    assert one == hmac.new(b"k" * 200, b"a|b", "sha512").hexdigest()
    assert pii.session_key(spark) != pii.session_key(spark)
    spark.conf.set("spark.augury.pseudonymSecret", "given")
    assert pii.session_key(spark) == "given"
    spark.conf.unset("spark.augury.pseudonymSecret")


def test_dates_are_permuted(spark):
    days = spark.range(0, 146000, 97).select(F.col("id"), pii.permute_number(F.col("id"), 365, 400, tuple(map(F.lit, pii.pads("k"))), "date").alias("v"))
    got = days.toPandas()
    assert got["v"].nunique() == len(got) and got["v"].between(0, 145999).all()


def test_language_model(docs, nothing, edges):
    got = lm.score_language(docs, block_chars=100_000).toPandas()
    rows = rows_of(docs)
    counts = Counter()
    for i, text in rows:
        if remainder(i, 7) != 2:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, remainder(i, 7) == 2, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 5)) for i, t in rows)
    have = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got.itertuples())
    assert have == want and (got["train_tokens"] == n).all()
    assert (got["score"] < 0).all() and (got["bits_per_byte"].median() < 4)
    assert lm.score_language(nothing).count() == 0
    assert lm.score_language(edges.where("doc_id = 900002")).count() == 1


@pytest.mark.parametrize("depth", [2, 4])
def test_context_tree_equals_brute_force(spark, depth):
    """Scores against a literal recursion over the tree of all training contexts, in blocks of a few texts; and their sum."""
    texts = ["abab ba", "aab", "b a b a Bab", "", "abba abab ab", "zz"] * 2 + ["\u00e9a b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_language(docs, depth=depth, block_chars=20).collect()}
    seen = Counter()

    def padded(text):
        return b"\xff" * depth + (text or "").translate(ASCII_LOW).encode() + b"\xff"

    for i, text in enumerate(texts):
        data = padded(text)
        for k in range(depth, len(data) if remainder(i, 7) != 2 else 0):
            for j in range(8):
                node, bit = (1 << j) | data[k] >> (8 - j), data[k] >> (7 - j) & 1
                for d in range(depth + 1):
                    seen[data[k - d : k], node, bit] += 1

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)

    contexts = [sorted({c for c, _, _ in seen if len(c) == d}) for d in range(depth + 1)]

    @functools.cache
    def block(c, node):
        own = kt(seen[c, node, 0], seen[c, node, 1])
        return own if len(c) == depth else np.logaddexp(own, sum(block(x, node) for x in contexts[len(c) + 1] if x.endswith(c))) - math.log(2)

    def chance(c, d, node, bit):
        s = c[len(c) - d :] if d else b""
        own = (seen[s, node, bit] + 0.5) / (seen[s, node, 0] + seen[s, node, 1] + 1)
        if d == depth:
            return own
        w = math.exp(kt(seen[s, node, 0], seen[s, node, 1]) - math.log(2) - block(s, node))
        return w * own + (1 - w) * chance(c, d + 1, node, bit)

    def byte(c, b):
        return math.prod(chance(c, 0, (1 << j) | b >> (8 - j), b >> (7 - j) & 1) for j in range(8))

    assert sum(byte(b"\xff" * (depth - 1) + b"a", b) for b in range(256)) == pytest.approx(1)
    for i, text in enumerate(texts):
        data = padded(text)
        assert got[i] == pytest.approx(sum(math.log10(byte(data[k - depth : k], data[k])) for k in range(depth, len(data))), abs=1e-5)


def test_context_tree_by_pieces(monkeypatch):
    """A group folded in pieces equals one folded at once."""
    rng = np.random.default_rng(2)
    runs = np.unique(rng.integers(0, 4, (4000, 5)) @ (256 ** np.arange(4, -1, -1)) & ~0xFFFF00 | 0x010200)
    n = rng.integers(0, 5, len(runs)).astype(float)
    given, left = np.full(255, 0.1), np.full(255, 0.8)
    whole = lm.code_lengths(runs, n, given, left, 4, 2)
    monkeypatch.setattr(lm, "_CHUNK_RUNS", 3)
    assert np.allclose(lm.code_lengths(runs, n, given, left, 4, 2), whole) and len(list(lm._chunks(runs, 2))) > 1


def test_decontamination(spark, docs, table, nothing):
    bench = table("benchmark")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    whole = items[0].split()
    planted = spark.createDataFrame([
        (800001, "before it " + items[0] + " and after"), (800002, " ".join(whole[len(whole) // 2 :]) + " something else here " + " ".join(whole[: len(whole) // 2])), (800003, " ".join(whole[: len(whole) // 3])), (800004, "nothing of it"), (800005, "tiny item"), (800006, items[0].upper()),
    ], "doc_id long, text string")
    more = bench.unionByName(spark.createDataFrame([(None, "x y z"), (777, None), (778, ""), (779, "tiny item")], "item_id long, text string"))
    both = docs.unionByName(planted, allowMissingColumns=True)
    got = decontam.decontaminate(both, more)
    assert got.columns == [*docs.columns, *(f"{c}_2" for c in ("contaminated", "coverage", "item_id", "n_items"))] and got.count() == both.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[k]["contaminated_2"] for k in range(800001, 800007)] == [True, True, False, False, True, True]
    assert by[800001]["item_id_2"] == 0 and by[800001]["coverage_2"] == 1.0 and by[800005]["item_id_2"] == 779
    kept = decontam.drop_leaks(both, more)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, r in ((r["doc_id"], r) for r in got.collect()) if not r["contaminated_2"])
    assert decontam.decontaminate(nothing, bench).count() == 0
    assert not decontam.decontaminate(docs, bench.where("false")).where("contaminated_2").count()


def test_items_of_one_id_and_other_types(spark):
    """Benchmark rows that repeat an id with another text are all items; ids may be text."""
    bench = spark.createDataFrame([("x", "one two three four five six"), ("x", "seven eight nine ten eleven twelve"), ("a", "seven eight nine ten eleven twelve")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "say seven eight nine ten eleven twelve"), (3, "one two three seven eight nine")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[2:]) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: (True, 1.0, "x", 1), 2: (True, 1.0, "a", 2), 3: (False, 0.0, None, 0)}


def brute_tiling(text, item, width=5):
    """Greedy string tiling by the book: the longest common unmarked run of words, again and again."""
    a, b = decontam.tokens(item), decontam.tokens(text)
    width, ma, mb = min(width, len(a)), [False] * len(a), [False] * len(b)
    while a:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < width:
            break
        for k in range(best[0]):
            ma[k - best[1]] = mb[k - best[2]] = True
    return sum(ma) / len(a) if a else 0.0


def test_tiling_against_brute_force(monkeypatch):
    draw = random.Random(5)
    monkeypatch.setattr(decontam, "_CHUNK", 7)  # matches are carried over pieces of a text
    for _ in range(60):
        item = [draw.choice("abc") * draw.randrange(1, 3) for _ in range(draw.randrange(3, 30))]
        parts = [item[k : k + draw.randrange(1, 12)] for k in (draw.randrange(len(item)) for _ in range(draw.randrange(1, 6)))]
        text = " ".join(w for part in parts for w in [*part, draw.choice(["zz", "a"])])
        assert decontam.coverage(text, " ".join(item)) == pytest.approx(brute_tiling(text, " ".join(item)), abs=1e-9)
    for words in (["w%d" % k for k in range(20)], ["v%d" % (k % 9) for k in range(25)]):
        for _ in range(20):
            text = " ".join(sum((words[k : k + draw.randrange(3, 12)] for k in draw.sample(range(20), 4)), []))
            assert decontam.coverage(text, " ".join(words)) == pytest.approx(brute_tiling(text, " ".join(words)))


def test_seeds_that_many_items_share_join_no_pairs(spark):
    opening = "please read the question with care"
    items = [(i, f"{opening} " + " ".join(f"q{i}x{k}" for k in range(24))) for i in range(60)]
    texts = [(k, f"{opening} " + " ".join(f"t{k}y{j}" for j in range(9))) for k in range(300)] + [(1000, items[7][1]), (1001, " ".join(items[9][1].split()[12:] + items[9][1].split()[:12]))]
    df, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seeds = decontam.seed_rows(decontam.item_seeds(benchmark))
    kept = decontam.telling_seeds(seeds, 0.8)
    opened = {s for s in decontam.window_hashes(decontam._Words().of(opening), 5).view(np.int64).tolist()}
    assert opened <= {r["seed"] for r in seeds.collect()} and not opened & {r["seed"] for r in kept.collect()}
    got = {r["doc_id"]: r["item_id"] for r in decontam.decontaminate(df, benchmark).where("contaminated").collect()}
    assert got == {1000: 7, 1001: 9}
    whole = decontam.decontaminate(df, benchmark).where("doc_id = 1000").first()
    assert whole["coverage"] == 1.0


def test_tiling_marks_longest_first():
    item = "a b c d e f g h i j k l"
    assert decontam.coverage("g h i j k l x a b c d e f", item) == 1.0
    assert decontam.coverage("a b c d e x c d e f g h", item) == pytest.approx(6 / 12)
    assert decontam.coverage("a b c d", item) == 0 and decontam.coverage(None, item) == 0 and decontam.coverage("x", "") == 0
    again = " ".join(["a b c d e f"] * 2000)  # a text and an item that repeat one phrase
    assert decontam.coverage(again, " ".join(["a b c d e f"] * 50)) == 1.0


def test_licenses(spark, docs, nothing):
    extra = [(700001, "Released under the MIT License."), (700002, "under the mit license under the mit license"), (700003, "CC BY-NC cc by nc"), (700004, "this work is licensed under the GNU General Public License, version 3."), (700005, "gnu public something license of three"), (700006, "Apache License, Version 2.0"), (700007, "Permission is hereby granted, free of charge. " + "and so on " * 40 + "to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction"), (700008, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files")]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = licenses.scan(both).toPandas()
    want = Counter()
    for i, text in rows_of(both):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOW))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[(i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
    clean = lambda x: None if pd.isna(x) else int(x)
    assert Counter((clean(r.doc_id), r.n_words, r.n_base, clean(r.first_word), clean(r.last_word), r.base_labels) for r in got.itertuples()) == want
    labels = dict(zip(got["doc_id"], got["labels"], strict=True))
    assert labels[700001] == "mit" and labels[700004] == "gpl-3" and labels[700005] == ""
    assert labels[700007] == "" and labels[700008] == "mit"  # the key phrase must stand at its place in the notice
    assert all(set(filter(None, b.split(","))) <= set(m.split(",")) for b, m in zip(got["base_labels"], got["labels"], strict=True))
    assert got["score"].between(0, 1).all() and got[got["labels"] == ""]["score"].max() < licenses.SCORE
    assert licenses.scan(nothing).count() == 0


def brute_fingerprint(text, width=4):
    w = words(text)
    if not w:
        return "0" * 16
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return format(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), "016x")


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(1) <= radius) + i + 1:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("options, radius", [({"group": 60}, 4), ({"group": 100, "width": 5, "bits": 256, "radius": 48}, 48)])
def test_simhash(docs, options, radius):
    got = simhash.near_duplicates(docs, **options).toPandas()
    if "bits" not in options:
        assert Counter((None if pd.isna(i) else int(i), f) for i, f in zip(got["doc_id"], got["fingerprint"], strict=True)) == Counter((i, brute_fingerprint(t)) for i, t in rows_of(docs))
    root = brute_components(simhash._numbers(got["fingerprint"]), radius)
    least = got["doc_id"].groupby(root).transform("min")
    assert got["component_id"].fillna(-1).tolist() == least.fillna(-1).tolist()


def test_simhash_matches_spark_hash(spark):
    one = spark.createDataFrame([("ein wort über",)], "text string").select(F.xxhash64("text")).first()[0]
    assert brute_fingerprint("ein wort über") == simhash.fingerprint("ein wort über") == format(one % 2**64, "016x")


def test_keep_one_alike(docs, nothing, spark):
    kept = simhash.keep_one_alike(docs, **simhash.SHARED)
    assert kept.columns == docs.columns
    named = simhash.alike_components(docs, **simhash.SHARED).toPandas()
    want = sorted(set(named["component_id"].dropna().astype(int)))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(nothing).count() == 0
    twice = spark.createDataFrame([(5, "alpha beta"), (5, "gamma delta"), (5, "gamma delta"), (6, "alpha beta"), (7, "Gamma delta")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one_alike(twice, **simhash.SHARED).collect()) == [(5, "alpha beta"), (5, "gamma delta")]
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    repeated = spark.createDataFrame([(5, near), (5, near + " more")], "doc_id long, text string")
    assert simhash.keep_one_alike(repeated, **simhash.SHARED).count() == 1


def test_chains_of_links(spark):
    """Components of a long chain and of a hub."""
    chain = [(f"{k:04d}", f"{k + 1:04d}") for k in range(200)] + [("9000", f"{k:04d}") for k in range(9001, 9100)]
    got = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert set(got.values()) == {"0000", "9000"} and len(got) == 200 + 99
