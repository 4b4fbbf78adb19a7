"""The stages: columns, order, and each stage's decision against a brute-force version on its own input."""

import corpus_pipeline
from augury.llm import decontam


def test_stages(spark, table):
    folder = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pseudonyms", "mixing"]
    from pyspark.sql import functions as F

    docs = table("documents").unionByName(spark.createDataFrame([(910001, None, "en", "src0", None), (910002, "12 34", "en", "src0", 5), (910003, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumns({c: F.lit("mine") for c in ("contaminated", "coverage", "item_id", "digest", "pii_found", "moved", "row", "component_id")})
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test")
        after = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        kept.append((before, after))
    (b0, a0), (b1, a1), (b2, a2), (b3, a3), (b4, a4) = kept
    assert not {910001, 910002, 910003} & set(a0) and len(a0) > 0.97 * (len(b0) - 3)
    from test_alike import brute_kept
    from test_operators import brute_tiling

    assert set(a1) == brute_kept({i: r["text"] for i, r in b1.items()})
    items = [r["text"] for r in table("benchmark").collect()]
    seeds = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(decontam.tokens, items)]

    def leaked(text):
        w = decontam.tokens(text)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return any(len(own & s) * 5 >= 0.8 * (len(s) + 4) and brute_tiling(text, item) >= 0.8 for s, item in zip(seeds, items, strict=True))

    assert set(b2) - set(a2) == {i for i, r in b2.items() if leaked(r["text"])}
    assert set(a3) == set(b3) and all(len(r["text"]) == r["n_chars"] for i, r in a3.items() if r["text"] != b3[i]["text"])
    assert all(0 < r["taken"] <= 3 * r["size"] for r in a4.values())


def test_run_is_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def written(spark, docs, folder):
    """A folder of input tables with ``docs`` for documents."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_no_documents(spark, table, tmp_path):
    got = corpus_pipeline.run(spark, written(spark, table("documents").where("false"), tmp_path))
    assert got.columns == corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns and got.count() == 0


def test_run_on_edge_rows(spark, table, edges, tmp_path):
    """The whole chain on nulls, a very long text, a row without id and a row that stands there 500 times."""
    from pyspark.sql import functions as F

    plain = table("documents")
    copy = edges.where("doc_id = 900006").limit(1).crossJoin(spark.range(500)).select(plain.columns)
    got = corpus_pipeline.run(spark, written(spark, plain.unionByName(edges).unionByName(copy), tmp_path))
    taken = {r["doc_id"]: r for r in got.collect()}
    assert len(taken) == got.count() and not {900001, 900002, 900003, 900004} & set(taken)
    # The copies are one document, and the long text is there with all its words.
    assert taken[900005]["size"] == 60_000 and all(0 < r["taken"] <= 3 * r["size"] for r in taken.values())
    assert got.where(F.col("doc_id") == 900006).count() <= 1
