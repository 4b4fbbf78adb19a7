"""Work that must not grow faster than its tables: equal rows, hopeless families, tasks, kept results and short series."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from augury.operators import backtest as B
from augury.operators import prep as C
from augury.operators import ranks as R
from augury.operators import train as T
from augury.plans import fixtures as X
from augury.plans import jobs, table_queries


def test_equal_rows_of_a_fold_are_one_with_its_weight(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7).cast("double").alias("_label"), (F.col("id") % 7).alias("_x0"))
    for task in ("regression", "classification"):
        got = T.dealt(rows, task, ["key"], 5).toPandas()
        assert got["_weight"].sum() == 4000 and len(got) == 35 and set(got["_fold"]) == set(range(5))


def test_families_that_cannot_win_stop_and_the_winner_is_that_of_all_folds(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.sin(F.col("id") / 300).alias("_label"), F.col("id").cast("double").alias("_x0"))
    marked = T.assembled(T.dealt(rows, "regression", ["key"], 5), ["_x0"], "_label", ["_fold", "_weight"]).persist()
    tried = {k: e.copy({e.weightCol: "_weight"}) for k, e in T.candidates("regression", 0, 4, 4, 1).items() if k in ("linear", "tree")}
    got = T.cv_stability(marked, tried, "regression", 5)
    score = RegressionEvaluator(metricName="r2")
    every = {n: [score.evaluate(e.fit(marked.where(F.col("_fold") != k)).transform(marked.where(F.col("_fold") == k))) for k in range(5)] for n, e in tried.items()}
    assert max(every, key=lambda n: np.mean(every[n])) == "tree" and np.allclose(got["tree"], every["tree"])
    assert len(got["linear"]) < 5 and np.allclose(got["linear"], every["linear"][: len(got["linear"])])


def test_rows_of_one_file_are_dealt_over_tasks(spark):
    rows = C.over_tasks(spark.range(40_000).withColumn("key", F.col("id").cast("string")).coalesce(1), ["key"])
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 15_000 and sum(sizes) == 40_000


def test_quantiles_read_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).mapInArrow(count, "id long")
    assert R.exact_quantiles(rows, {"id": F.col("id")}, [0.5])["id"] == [499.5] and seen.value == 1000


def test_means_of_encodings_are_kept(spark):
    assert any("augury-means" in f for f in table_queries.encoded(spark, DATA)[1].inputFiles())


def test_patterns_that_change_the_same_columns_share_a_run(spark, monkeypatch):
    runs, run = [], jobs.run_tabular
    monkeypatch.setattr(jobs, "run_tabular", lambda *a, **k: runs.append(k["pattern"]) or run(*a, **k))
    parts = X.text_numbers(spark, DATA).join(X.table(spark, DATA, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    options = {"most_attempts": 1, "families": ["tree"]}
    got = jobs.coercion_impact(parts.select("p_partkey", "price", "hours", "p_retailprice"), ["p_partkey"], "p_retailprice", **options).drop("pattern").collect()
    assert len(got) == 2 and got[0] == got[1] and len(runs) == 1
    jobs.coercion_impact(parts.select("p_partkey", "price", "style", "p_retailprice"), ["p_partkey"], "p_retailprice", **options)
    assert len(runs) == 3


def test_bands_of_many_short_series_are_read_one_after_another(spark):
    keys = ["k", "x"]
    rows = [(k, float("nan") if k == 3 else 1.0, step, float(r)) for k in [None, *range(40)] for step in (1, 3) for r in np.random.default_rng(k or 99).normal(size=4).round(3)]
    known = spark.createDataFrame(rows, "k long, x double, step int, residual double")
    sizes = known.select(*keys).distinct().withColumn("h", F.when(F.col("k") % 2 == 0, 2).otherwise(4))
    found = B.interval_offsets(known, keys, sizes)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = {(r["k"], r["step"]): (r["low"], r["high"]) for r in found.collect()}
    assert len(got) == sum(2 if k is not None and k % 2 == 0 else 4 for k in [None, *range(40)])
    for (k, step), (low, high) in got.items():
        own = [r for kk, _, s, r in rows if kk == k and s <= step]
        assert np.allclose([low, high], np.quantile(own, [0.1, 0.9]))


def test_classes_are_cut_into_ranges_without_moving_their_rows(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, "big").when(F.col("id") < 4903, "small").when(F.col("id") < 4905, "two").alias("c"))
    code, ends = F.md5(F.col("id").cast("string")), lambda n: [F.ceil(n * k / 5) for k in range(1, 5)]
    placed = C.class_places(rows, "c", code).withColumn("want", sum(((F.col("_place") > e).cast("int") for e in ends(F.col("_n"))), F.lit(0))).select("id", "want")
    for prefix in (0, 1, 3):
        ranged = C.class_ranges(rows, "c", code, ends, "got", prefix)
        assert ranged.join(placed, "id").where("got = want").count() == 5000
        assert "hashpartitioning" not in ranged._jdf.queryExecution().toString() and "Window" not in ranged._jdf.queryExecution().toString()
    split = C.split(rows, ["id"], stratify="c")._jdf.queryExecution().toString()
    assert "hashpartitioning" not in split and "Window" not in split
    # Ends between equal codes: rows of one key are still dealt evenly.
    one = C.class_ranges(rows.withColumn("id", F.lit(1)), "c", F.md5(F.col("id").cast("string")), ends, "got")
    sizes = {(r["c"], r["got"]): r["count"] for r in one.groupBy("c", "got").count().collect()}
    assert all(sizes["big", k] == 800 for k in range(5)) and all(sizes[None, k] == 19 for k in range(5)) and {sizes["small", k] for k in range(5)} == {180, 181}


def test_keys_that_read_as_numbers_stay_apart(spark, monkeypatch):
    class Enough(Exception):
        pass

    def stop(df, *a, **k):
        raise Enough(df)

    monkeypatch.setattr(C, "split", stop)
    rows = spark.range(400).select(F.concat((9007199254740992 + F.col("id")).cast("string"), F.lit(" a")).alias("key"), F.concat(F.col("id").cast("string"), F.lit(" km")).alias("x"), (F.col("id") % 2).cast("string").alias("kind"))
    with pytest.raises(Enough) as got:
        jobs.run_tabular(rows, ["key"], "kind")
    kept = got.value.args[0]
    assert dict(kept.dtypes)["key"] == "string" and dict(kept.dtypes)["x"] == "double" and kept.select("key").distinct().count() == 400
