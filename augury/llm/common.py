"""Helpers that the operators share: word rules, row splits, bounded samples and materialised tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a Java / Python character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_py_word = re.compile(WORD)
_py_letters = re.compile(r"[^\W\d_]+")
_ascii_lower = str.maketrans(UPPER, LOWER)


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all other characters as they are."""
    return text.lower() if text.isascii() else text.translate(_ascii_lower)


def py_words(text: str | None) -> list[str]:
    """Runs of anything but the six ASCII white-space characters; none for a null text.

    ``bytes.split`` cuts at exactly those six, so it is used instead of a pattern: UTF-8 never has them inside a character.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def letter_runs(text: str | None) -> list[str]:
    """Lower-case runs of letters; none for a null text."""
    return _py_letters.findall(text.lower()) if text else []


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower_col(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/augury-shared"
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost executor never recomputes what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/augury-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id as text, text, more) for functions in Python: a long with nulls would come there as a float."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *more)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or the first of name_2, name_3, ... that no column in ``taken`` has, in whatever case."""
    used, k, found = {c.lower() for c in taken}, 1, name
    while found.lower() in used:
        k += 1
        found = f"{name}_{k}"
    return found


def sample_per_class(rows: DataFrame, label: str, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows of each class (all rows of a class with fewer), chosen by a hash of ``key``.

    One aggregate gives the class sizes; the classes are joined back, so nothing is sorted and no class meets in one task.
    The choice depends on the key alone: reruns agree.
    """
    share = rows.groupBy(label).agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count(F.lit(1))).alias("_share"))
    unit = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(share), label).where(unit < F.col("_share")).drop("_share")


def slices(batches: Iterable[pd.DataFrame], text: str = "text", most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that each piece holds at most ``most`` characters, or one row."""
    for batch in batches:
        if not len(batch):
            continue
        size = batch[text].str.len().fillna(0).cumsum()
        for _, piece in batch.groupby((size // most).astype("int64").to_numpy(), sort=True):
            yield piece.reset_index(drop=True)
