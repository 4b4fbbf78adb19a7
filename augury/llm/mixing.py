"""Mixing sources to target weights.

The words of each source, in a pseudorandom order of its documents, form a stream that is cut into blocks of fixed length.
Targets are set by weight, at most ``most`` times a source's size.  Every source has as many slots as its target needs, and a
keyed permutation of all slots deals them into output shards.  The numbers of a source's slots in a shard are thus multinomial
counts given their totals (a multivariate hypergeometric draw): independent multinomial draws would miss small sources' targets
by the root of their slots.  A slot's place within its source goes through the source's own permutation of block numbers,
another for each pass over the source, and blocks are joined to documents by their number.  What the mix takes of a document is
summed over the dealt slots of all shards.

Sizes, offsets, slots and joins are DataFrame operations; no source meets in one task: offsets are sums over small hash
buckets, added up in two levels, and slots and blocks are keyed by source and number.

Defined results: null and empty texts have size 0 and nothing is taken; a null source is a source of its own, last in order;
repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import WORD, materialise

BLOCK_WORDS = 2048
SHARD_SLOTS = 1024
MOST = 3
WEIGHTS = (1, 2, 3)
_BUCKET_ROWS = 512  # documents in a bucket whose offsets one task sums
_SUPER_BUCKETS = 4096  # buckets of a source whose offsets one task adds up
_CHUNK_SLOTS = 10_000  # slots that one row unfolds into


def word_count(text: Column) -> Column:
    """Number of words: each is replaced by one character, then white space goes."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *key: Column | str, rounds: int = 6, walks: int = 24) -> Column:
    """``x`` in 0..n-1 moved by a pseudorandom permutation of that range: a Feistel network with cycle walking.

    The network works on a x b >= n with a the root of n rounded up; fewer than a of its values lie outside the range, so a
    walk longer than ``walks`` has a chance below n ** -12.
    """
    keys = [F.lit(k) if isinstance(k, str) else k for k in key]
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def network(v: Column) -> Column:
        halves = F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)),
            F.struct((v / b).cast("long").alias("l"), (v % b).cast("long").alias("r")),
            lambda s, i: F.when(i % 2 == 1, F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(*keys, i, s["r"]), a), a).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(*keys, i, s["l"]), b), b).alias("r"))
            ),
        )
        return F.transform(F.array(halves), lambda s: s["l"] * b + s["r"])[0]

    first = network(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda v, _: F.when(v < n, v).otherwise(network(v)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add weight and target to a table (key, source_size) of sources.

    Targets share the sum of all sizes by weight, none above ``most`` times its size: sorted by the ratio of cap to weight, the
    capped sources come first, and the level of the rest is set by the first whose cap is not below it.  The table has a row
    for each source, so its windows are small.
    """
    order = Window.orderBy("key")
    by_ratio = Window.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("ratio") >= F.col("level"))
    ranked = ranked.withColumn("level", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct("ratio", "key"))).over(everything))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).select("key", "source_size", "weight", "target")


def _numbered_copies(rows: DataFrame, chunk: int = _CHUNK_SLOTS) -> DataFrame:
    """``rows`` with a place of its own for each repeat of a row: equal rows are counted, then unfolded in chunks by number."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / chunk)))).repartition("place", "chunk")
    copy = F.explode(F.sequence(F.col("chunk") * chunk, F.least("copies", (F.col("chunk") + 1) * chunk) - 1))
    place = F.when(F.col("copy") > 0, F.xxhash64("place", "copy")).otherwise(F.col("place"))
    return chunks.withColumn("copy", copy).withColumn("place", place).select(*rows.columns)


def stream_offsets(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, key (the source, sortable with null last), size and offset (words of its source before it) of every row."""
    own = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~")).alias("key"), word_count(F.col("text")).alias("size"), own.alias("place"))
    rows = materialise(_numbered_copies(rows), "sizes")
    buckets = max(1, -(-rows.count() // _BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("place", F.lit(buckets)))
    before = lambda total, order, *by: F.coalesce(F.sum(total).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = materialise(rows.groupBy("key", "bucket").agg(F.sum("size").alias("words")).withColumn("super", F.floor(F.col("bucket") / _SUPER_BUCKETS)), "buckets")
    supers = totals.groupBy("key", "super").agg(F.sum("words").alias("words")).select("key", "super", before("words", ["super"], "key").alias("base"))
    starts = totals.withColumn("near", before("words", ["bucket"], "key", "super")).join(supers, ["key", "super"]).select("key", "bucket", (F.col("base") + F.col("near")).alias("start"))
    rows = rows.withColumn("inner", before("size", ["place", "doc_id"], "key", "bucket"))
    return materialise(rows.join(starts, ["key", "bucket"]).select("doc_id", "key", "size", (F.col("start") + F.col("inner")).alias("offset")), "offsets")


def deal_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = "mix") -> DataFrame:
    """One row for each output slot: shard, slot, key, pass (over the source), block and words (taken from its start).

    Whole passes over a source take every block once, the short last one too.  What is left of the target is taken from full
    blocks, the last of them in part, and from the short block only if nothing else is left.
    """
    want, size = F.round("target").cast("long"), F.col("source_size")
    s = sources.where("source_size > 0").withColumns({"passes": F.floor(want / size), "blocks": F.ceil(size / block_words).cast("long"), "full": F.floor(size / block_words).cast("long")})
    s = s.withColumn("rest", F.greatest(want - F.col("passes") * size, F.lit(0))).withColumn("extra", F.ceil(F.col("rest") / block_words).cast("long"))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("extra")).where("slots > 0")
    s = s.withColumn("first", F.sum("slots").over(Window.orderBy("key")) - F.col("slots")).withColumn("all", F.sum("slots").over(Window.partitionBy()))
    chunks = s.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / _CHUNK_SLOTS)))).repartition("key", "chunk")
    k = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * _CHUNK_SLOTS, F.least(F.col("slots"), (F.col("chunk") + 1) * _CHUNK_SLOTS) - 1)))
    k = k.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).withColumn("pass", F.least("pass", "passes")).withColumn("j", F.col("k") - F.col("pass") * F.col("blocks"))
    whole = F.col("pass") < F.col("passes")
    domain = F.when(whole, F.col("blocks")).otherwise(F.greatest(F.col("full"), F.lit(1)))
    # The domain holds j unless only the short block is left: then j is its number.
    block = F.when(F.col("j") < domain, permuted(F.least("j", domain - 1), domain, seed, F.col("key"), F.col("pass"))).otherwise(F.col("j"))
    k = k.withColumn("block", block)
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    k = k.withColumn("words", F.when(whole, length).otherwise(F.least(length, F.col("rest") - F.col("j") * block_words)))
    dealt = permuted(F.col("first") + F.col("k"), F.col("all"), seed, "shards")
    return k.withColumn("dealt", dealt).select(F.floor(F.col("dealt") / shard_slots).alias("shard"), (F.col("dealt") % shard_slots).alias("slot"), "key", "pass", "block", "words")


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int, block_words: int, shard_slots: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with offsets, sources with targets, dealt slots, and the parts of documents in blocks (key, block, begin, end)."""
    rows = stream_offsets(docs, seed)
    sources = materialise(source_targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    slots = deal_slots(sources, block_words, shard_slots, seed)
    touched = F.sequence(F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("size") - 1) / block_words))
    parts = rows.where("size > 0").withColumn("block", F.explode(touched))
    edge = F.col("block") * block_words
    parts = parts.select("key", "block", "doc_id", "offset", F.lit(block_words).alias("block_words"), F.greatest("offset", edge).alias("begin"), F.least(F.col("offset") + F.col("size"), edge + block_words).alias("end"))
    return rows, sources, slots, parts


def shard_counts(slots: DataFrame) -> DataFrame:
    """The draw: shard, key and n, the number of slots that the source has in the output shard."""
    return slots.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n"))


def _pieces(slots: DataFrame, parts: DataFrame) -> DataFrame:
    """Slots joined to the parts of documents in their blocks, with the words that are taken of each part."""
    stop = F.least(F.col("end"), F.col("block") * F.col("block_words") + F.col("words"))
    return slots.join(parts, ["key", "block"]).withColumn("n_words", stop - F.col("begin")).where("n_words > 0")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and n_shards (output shards that hold
    words of it) of every row of ``docs``."""
    rows, sources, slots, parts = _plan(docs, weights, most, block_words, shard_slots, seed)
    # A document's words in a shard first: those of a very long one are spread over many.
    by_shard = _pieces(slots, parts).groupBy("key", "offset", "shard").agg(F.sum("n_words").alias("n_words"))
    taken = by_shard.groupBy("key", "offset").agg(F.sum("n_words").alias("taken"), F.count(F.lit(1)).alias("n_shards"))
    # Only documents with words have an offset of their own.
    got = rows.where("size > 0").join(taken, ["key", "offset"], "left").unionByName(rows.where("size = 0").withColumns({"taken": F.lit(0), "n_shards": F.lit(0)}))
    return got.join(sources, "key").select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")])


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = "mix") -> DataFrame:
    """The mix itself: shard, slot, words and pieces (doc_id, first word and number of words, in order) of each output block."""
    _, _, slots, parts = _plan(docs, weights, most, block_words, shard_slots, seed)
    piece = F.struct("begin", "doc_id", (F.col("begin") - F.col("offset")).alias("first_word"), "n_words")
    # A block has at most block_words pieces.
    return _pieces(slots, parts).groupBy("shard", "slot", "words").agg(F.sort_array(F.collect_list(piece)).alias("pieces")).select("shard", "slot", "words", F.transform("pieces", lambda p: p.dropFields("begin")).alias("pieces"))
