"""Quality rules by tokeniser fertility.

Public vocabularies measure every whole text: characters per token and the entropy of its tokens (in bits) under a byte-level
BPE vocabulary, and the share of single-byte pieces under a vocabulary with byte fallback.  A text outside the band of a measure
is rejected.  Bands come from the corpus: ``FENCE`` times the spread between the quartiles beyond them, over all texts that pass
the base rules, of the same script, language and size (both measures of tokens depend on the length of a text).  A group of
fewer than ``LEAST`` texts takes the bands of its script and language, then of its script, then of its language; a text for which
all are smaller has none.

Base rules on words, lines and repetition come first.  A word's tokens do not depend on its neighbours here (both vocabularies
cut at white space first), so each distinct word of a slice of rows is tokenised once and looked up.  The vocabulary files are
sent to the executors with the job; each task loads them once.

Defined results: null and empty texts have no words and fail the base rules; texts without a token have 0 for all measures; a
null language is a language of its own; very long texts are measured whole; repeated rows get equal results.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import ids_and_texts, materialise, slices

TOKENIZERS = "/opt/tokenizers"
BPE, FALLBACK = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"

# Measures with the least spread between quartiles that a band assumes, and the decimal places to which quartiles see them.
MEASURES = {"chars_per_token": (0.02, 3), "byte_share": (0.01, 4), "token_entropy": (0.05, 3)}
FENCE = 3.0
LEAST = 100  # texts that give a group bands of its own
_SALTS = 256  # parts of a group's rows that may be joined to its bands in different tasks
SCRIPTS = ["latin", "greek", "cyrillic", "arabic", "indic", "cjk", "other"]
_SYMBOLS = b"#*$%&|<>"
_symbol = np.zeros(256, bool)
_symbol[list(_SYMBOLS)] = True


@lru_cache(maxsize=2)
def vocabularies(bpe_file: str, fallback_file: str):
    """The byte-level BPE encoding and the vocabulary with byte fallback, with its byte pieces as a mask."""
    import sentencepiece
    import tiktoken

    with open(bpe_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    # Words are given with the space before them and without other white space, so the pattern only parts letters, digits and signs.
    bpe = tiktoken.Encoding("own", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=fallback_file)
    return bpe, pieces, np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])


def script_of(word: str) -> int:
    """Index in SCRIPTS of the first letter of a word; ``other`` without one."""
    for ch in word:
        if ch.isalpha():
            c = ord(ch)
            if c < 0x250 or 0x1E00 <= c < 0x1F00:
                return 0
            if 0x370 <= c < 0x400:
                return 1
            if 0x400 <= c < 0x530:
                return 2
            if 0x590 <= c < 0x780:
                return 3
            if 0x900 <= c < 0xE00:
                return 4
            if 0x1100 <= c < 0x1200 or 0x2E80 <= c < 0xFB00:
                return 5
            return 6
    return 6


def repeat_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:] if base < 2**20 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(count[which] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(texts: list[str | None], files: tuple[str, str]) -> pd.DataFrame:
    """All measures of each text."""
    bpe, pieces, is_byte = vocabularies(*files)
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    split = [raw.split() for raw in raws]
    index = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    names = [w.decode("utf-8", "replace") for w in index]
    chars = np.fromiter(map(len, names), np.int64, len(names))
    script = np.fromiter(map(script_of, names), np.int64, len(names))
    encoded = [bpe.encode_ordinary(" " + w) for w in names]
    size = np.fromiter(map(len, encoded), np.int64, len(names))
    start = np.concatenate([[0], np.cumsum(size)])
    tokens = np.fromiter((t for e in encoded for t in e), np.int64, int(start[-1]))
    cut = pieces.encode(names, num_threads=1) if names else []
    n_pieces = np.fromiter(map(len, cut), np.int64, len(names))
    owner = np.repeat(np.arange(len(names)), n_pieces)
    n_bytes = np.bincount(owner, is_byte[np.fromiter((p for c in cut for p in c), np.int64, int(n_pieces.sum()))], len(names)) if len(owner) else np.zeros(len(names))
    out = []
    for raw, words in zip(raws, split, strict=True):
        n = len(words)
        ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n_tok, entropy = int(size[ids].sum()), 0.0
        if n_tok > 1:
            own = size[ids]
            at = np.repeat(start[ids] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(n_tok)
            p = np.unique(tokens[at], return_counts=True)[1] / n_tok
            entropy = float(-(p * np.log2(p)).sum())
        kind = int(np.bincount(script[ids], chars[ids], len(SCRIPTS)).argmax()) if n else 6
        n_piece = int(n_pieces[ids].sum())
        out.append((n, int(chars[ids].sum()), int(_symbol[np.frombuffer(raw, np.uint8)].sum()), len(lines) - len(set(lines)), repeat_words(ids), SCRIPTS[kind], float(chars[ids].sum() / n_tok) if n_tok else 0.0, float(n_bytes[ids].sum() / n_piece) if n_piece else 0.0, entropy, n_tok))
    return pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "chars_per_token", "byte_share", "token_entropy", "n_tokens"])


def measures(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, base counts, base_failed, script, the three measures and n_tokens; map-only."""
    kind, context = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext
    for name in (BPE, FALLBACK):
        context.addFile(os.path.join(folder, name))

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = (SparkFiles.get(BPE), SparkFiles.get(FALLBACK))
        for piece in slices(batches):
            m = measure(piece["text"].tolist(), files)
            m.insert(0, "lang", piece["lang"].array)
            m.insert(0, "doc_id", piece["doc_id"].array)
            m["base_failed"] = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            yield m

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return ids_and_texts(docs, lang.alias("lang")).mapInPandas(
        rules, "doc_id string, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_token double, byte_share double, token_entropy double, n_tokens long, base_failed boolean"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))


def _size(n_tokens: Column) -> Column:
    """Number of binary digits of the tokens: texts of one size differ by less than a factor of two."""
    return F.floor(F.log2(F.greatest(n_tokens, F.lit(1)))).cast("int")


def bands(measured: DataFrame, by: list[str], fence: float = FENCE, least: int = LEAST) -> DataFrame:
    """``by`` and, for each measure, the lowest and highest value that is kept; of groups with ``least`` texts or more.

    The quartiles are exact for values of a few decimal places, of which a group has a bounded number.
    """
    passed = measured.where("not base_failed")
    facts = passed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile(F.round(m, places), F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m, (_, places) in MEASURES.items()])
    ends = []
    for m, (spread, _) in MEASURES.items():
        reach = fence * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(spread))
        ends.append(F.struct((F.col(m)[0] - reach).alias("low"), (F.col(m)[1] + reach).alias("high")).alias(m))
    return facts.where(F.col("_n") >= least).select(*by, F.struct(*ends).alias("band"))


def quality_rules(docs: DataFrame, folder: str = TOKENIZERS, fence: float = FENCE, least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base counts, base_failed, kept, script and the three measures."""
    group = ["script", "_lang", "_size"]
    rows = materialise(measures(docs, folder), "fertility").withColumns({"_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "_size": _size(F.col("n_tokens"))})
    groups = rows.select(*group).distinct()
    for k, by in enumerate((group, ["script", "_lang"], ["script"], ["_lang"])):
        groups = groups.join(bands(rows, by, fence, least).withColumnRenamed("band", f"_band{k}"), by, "left")
    # The few groups are repeated for each salt, so that the rows of a large one are joined in many tasks.
    salted = materialise(groups, "bands").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", "chars_per_token"), F.lit(_SALTS)).cast("int"))
    found = rows.join(salted, [*group, "_salt"])
    band = F.coalesce("_band0", "_band1", "_band2", "_band3")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(m).between(band[m]["low"], band[m]["high"]), F.lit(True))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *MEASURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
