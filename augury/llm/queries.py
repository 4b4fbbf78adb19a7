"""The registered queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from augury.llm import decontam, fertility, langid, licenses, lm, minhash, mixing, pii, quality, search, simhash, toxicity, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(_table(spark, sf_dir, "documents"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark)).select("doc_id", "text", "pii_found")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_language(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_fertility": op3_fertility,
        "op4_pseudonyms": op4_pseudonyms,
        "op5_language": op5_language,
        "op6_context_tree": op6_context_tree,
        "op7_decontamination": op7_decontamination,
        "op8_licenses": op8_licenses,
        "op9_simhash": op9_simhash,
        "op10_quality": op10_quality,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_minhash": op12_minhash,
        "op13_search": op13_search,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x20\x09-\x0D]+"

#: The trie by brute force: a node is the hashes of its turns, 33 characters each, and every node adds to all before it.
TRIE = rf"""
WITH crc_table AS (
    SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
), turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (
    SELECT conv_id, max(pos) AS n, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes FROM turns GROUP BY conv_id
), sizes AS (
    SELECT conv_id, n, conv_id - conv_id % 20 AS first,
        xor(list_reduce(list_concat([4294967295], codes), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4 AS h
    FROM bytes, crc_table
), convs AS (
    SELECT s.conv_id, s.first, s.h, least(s.h, coalesce(f.n, 0)) AS k, least(s.h, coalesce(f.n, 0)) + greatest(s.n - s.h, 0) AS length
    FROM sizes s LEFT JOIN sizes f ON f.conv_id = s.first
), rebuilt AS (
    SELECT c.conv_id, t.pos AS depth, role, text, length FROM convs c JOIN turns t ON t.conv_id = c.first AND t.pos <= c.k
    UNION ALL SELECT c.conv_id, t.pos - h + k, role, text, length FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
    SELECT conv_id, depth, string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS node,
        len(regexp_extract_all(text, '{WORDS}')) AS words, length FROM rebuilt
    UNION ALL SELECT conv_id, 0, '', 0, length FROM convs
), nodes AS (
    SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
        string_agg(CASE WHEN depth = length THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
    FROM paths GROUP BY depth, node
), parented AS (
    SELECT *, CASE WHEN depth = 1 THEN '' WHEN depth > 1 THEN left(node, 33 * (depth - 1) - 1) END AS parent FROM nodes
), children AS (
    SELECT parent, count(*) AS n FROM parented WHERE parent IS NOT NULL GROUP BY parent
), above AS (
    SELECT p.saved, c.n IS NULL AS leaf, unnest(list_transform(range(0, p.depth + 1), lambda k: CASE WHEN k = 0 THEN '' ELSE left(p.node, 33 * k - 1) END)) AS node
    FROM parented p LEFT JOIN children c ON c.parent = p.node
), totals AS (SELECT node, sum(CAST(leaf AS INT)) AS n_leaves, sum(saved) AS saved FROM above GROUP BY node)
SELECT p.conv_id, p.depth, q.conv_id AS parent_conv_id, p.n_convs, coalesce(c.n, 0) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
    CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(p.ends, '')) AS ends_sha256
FROM parented p LEFT JOIN nodes q ON q.node = p.parent LEFT JOIN children c ON c.parent = p.node JOIN totals t ON t.node = p.node
"""

#: All pairs of texts that share a shingle, and what their links reach.
MINHASH = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents
), shingled AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), each AS (SELECT doc_id, unnest(s) AS shingle FROM shingled
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS (SELECT a, b FROM shared JOIN shingled x ON x.doc_id = a JOIN shingled y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, l.b FROM reach JOIN links l ON l.a = other)
SELECT r.doc_id, len(max(s.s)) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reach r JOIN shingled s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

SEARCH = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), whole AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM texts
), found AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM texts
), counts AS (SELECT doc_id, n, term, count(*) AS tf FROM found GROUP BY doc_id, n, term
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term
), adds AS (SELECT doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS s FROM counts c JOIN weights w ON w.term = c.term, whole
), asked AS (SELECT DISTINCT item_id, text FROM benchmark
), wanted AS (SELECT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked
), scores AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM wanted JOIN adds ON wanted.term = adds.term GROUP BY item_id, doc_id HAVING sum(s) > 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Operators that SQL can express; the others are tested against brute-force versions in tests/llm."""
    return {"op11_prefix_trie": TRIE, "op12_minhash": MINHASH, "op13_search": SEARCH}
