"""The training step at size: what it keeps in memory, moves and works out twice."""

from collections import Counter

from compare import DATA
from pyspark.sql import functions as F

from augury.operators import prep as C
from augury.operators import profile as P
from augury.operators import train as T
from augury.plans import fixtures as X
from augury.plans import jobs
from augury.sources import tables as A


def test_training_leaves_memory_to_its_fits(spark):
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before = kept()
    out = jobs.run_tabular(X.priced_lines(spark, DATA), ["row_key"], "l_extendedprice", most_attempts=1, families=["linear"])
    assert kept() <= before and all("augury-table" in f for f in out["prepared"].inputFiles())
    assert out["prepared"].where("not is_train").count() > 0


def test_rows_that_are_alike_meet_in_one_shuffle(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7).cast("double").alias("_label"), (F.col("id") % 7).cast("double").alias("_x0"))
    once, want = T.dealt(rows, "regression", ["key"], 5, parts=3), T.dealt(rows, "regression", ["key"], 5)
    assert once.rdd.getNumPartitions() == 3 and once.select(*want.columns).exceptAll(want).count() == 0 and once.count() == 35
    once.collect()
    assert once._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1


def test_tasks_are_a_multiple_of_those_that_run_at_once(spark):
    n = spark.sparkContext.defaultParallelism
    assert [C.task_count(spark, k) for k in (0, 5_000, 10_000, 400_000, n * 500_000, n * 500_000 + 1, n * 1_200_000)] == [1, 1, 2, n, n, 2 * n, 3 * n]


def test_a_file_of_one_row_group_is_written_again_in_parts(spark):
    rows = C.written_evenly(spark.range(400_000).select("id", F.md5(F.col("id").cast("string")).alias("key")).coalesce(1), "one", ["key"])
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 400_000 and max(sizes) <= 200_000


def test_counts_of_columns_apart_and_few_equal_rows(spark):
    rows = spark.createDataFrame([(1.5, "a", None), (1.5, "a", None), (None, "a", None), (2.0, None, "a"), (2.0, "a", None), (1.5, "a", None)], "x double, `a.b` string, c string")
    assert Counter(map(tuple, P.value_counts(rows, apart=True).collect())) == Counter(map(tuple, P.value_counts(rows).collect()))
    assert P.duplicate_rows(rows, few=True).first()[0] == P.duplicate_rows(rows).first()[0] == 2
    assert P.duplicate_rows(rows.distinct(), few=True).first()[0] == 0 == P.duplicate_rows(rows.limit(0), few=True).first()[0]


def test_events_of_one_row_work_it_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    one = spark.range(1).mapInArrow(count, "id long")
    got = A.events(one, [("a", "x", {"n": F.col("id")}), ("b", F.lit("y"), {}, "why", "warn"), ("c", "z", {})]).drop("ts").collect()
    assert [tuple(r) for r in got] == [("a", "x", None, '{"n":0}', "ok"), ("b", "y", "why", "{}", "warn"), ("c", "z", None, "{}", "ok")] and seen.value == 1
