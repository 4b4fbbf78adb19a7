import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} and" for i in range(30_000))
# Null, empty, letterless and very long texts, a repeated row, a null id and null columns.
EDGES = [
    (900001, None, "en", "src0", None),
    (900002, "", "en", None, 0),
    (900003, " \n\t ", None, "src1", 4),
    (900004, "1234 5678 !!", "de", "src1", 12),
    (900005, LONG, "en", "src2", len(LONG)),
    (900006, "the same row twice over", "en", "src3", 23),
    (900006, "the same row twice over", "en", "src3", 23),
    (None, "a row without an id", "en", "src3", 19),
    (900007, "Wörter ähnlich über straße. 日本語 mail jo.doe@example.org", "xx", "src4", 50),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(table, edges):
    """Small documents with edge rows and columns whose names the operators use themselves."""
    both = table("documents").unionByName(edges)
    return both.withColumns({c: F.lit("mine") for c in ("score", "block", "held_out", "words", "size", "key", "fp", "spaced", "place", "row", "train", "contaminated", "coverage", "item_id", "n_items", "digest", "pii_found", "moved", "_moved", "kept", "script", "hits", "present", "component_id", "kept_row")})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
