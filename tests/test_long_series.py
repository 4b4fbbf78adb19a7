"""Null keys, long series in parts, folds side by side, failure notes and logs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.functions import forecasters as models
from augury.operators import backtest as B
from augury.operators import scan
from augury.operators import series as S
from augury.plans import jobs
from augury.sources import tables as A

DAY = dt.date(2024, 1, 1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(k, i, None if (i * 7 + (k == "a")) % 5 in (1, 2) or i % 17 in (0, 16) else float(i * i % 31)) for k in ("a", None) for i in range(60)]
    return spark.createDataFrame(rows, "key string, pos long, y double").withColumn("ds", F.date_add(F.lit(DAY), F.col("pos").cast("int")))


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_parts_give_what_windows_give(gappy, keys):
    series = gappy if keys else gappy.where("key = 'a'").drop("key")
    k = ["key"]
    whole = gappy if keys else gappy.where("key = 'a'")
    cut = lambda df: df if keys else df.drop("key")
    for part in (1, 4, 1000):
        trimmed = S.trim_edges(series, keys, part)
        assert rows_of(trimmed) == rows_of(cut(S.trim_edges(whole, k)))
        assert rows_of(S.gap_runs(trimmed, keys, part)) == rows_of(cut(S.gap_runs(S.trim_edges(whole, k), k)))
        for strategy in S.STRATEGIES:
            got = S.fill_gaps(series, keys, strategy, part).withColumn("y", F.round("y", 9))
            assert rows_of(got) == rows_of(cut(S.fill_gaps(whole, k, strategy)).withColumn("y", F.round("y", 9)))
    stamps = series.withColumnRenamed("ds", "t").where("pos % 3 > 0")
    if not keys:
        want = S.frequency(stamps.withColumn("key", F.lit("a")), "t", k).drop("key")
        assert rows_of(S.frequency(stamps, "t", [], 4)) == rows_of(want)


def test_a_null_key_is_a_series(spark):
    rows = [(k, DAY + dt.timedelta(days=i), float(i % 7) + 0.1 * i) for k in ("a", None) for i in range(60) if i % 13]
    df = spark.createDataFrame(rows, "key string, day date, y double").withColumn("day", F.col("day").cast("timestamp"))
    for model in ("naive", "auto"):
        out = jobs.run_forecast(df, "y", "ffill", keys=["key"], time_col="day", horizon=3, model=model)
        for name in ("status", "facts", "forecast", "audit", "metrics", "history"):
            assert {r["key"] for r in out[name].select("key").distinct().collect()} == {"a", None}, name
        both = out["forecast"].groupBy("step").agg(F.count_distinct("yhat").alias("n"), F.count("yhat").alias("m"), F.count_distinct("lower").alias("l"))
        assert {(r["n"], r["m"], r["l"]) for r in both.collect()} == {(1, 2, 1)}
        assert [r["status"] for r in out["status"].collect()] == ["ok", "ok"]


def test_folds_side_by_side_give_the_same(spark, gappy):
    full = S.fill_gaps(S.trim_edges(gappy, ["key"]), ["key"], "ffill")
    origins = B.backtest_origins(B.sizes(full, ["key"], 4), ["key"])
    each = [rows_of(B.backtest_model(full, ["key"], origins, "auto", by_fold=x)) for x in (False, True)]
    assert each[0] == each[1] and len(each[0]) == 2 * 5 * 4
    one = full.where("key = 'a'").drop("key")
    single = B.backtest_model(one, [], origins.where("key = 'a'").drop("key"), "auto")
    assert single.rdd.getNumPartitions() == B.FOLDS
    assert rows_of(single) == rows_of(B.backtest_model(full.where("key = 'a'"), ["key"], origins, "auto").drop("key"))


def test_failures_are_told(spark):
    def picky(past, h):
        if len(past) > 40:
            raise ValueError("too long a past")
        return [1.0] * h

    B.register_forecaster("picky", picky)
    rows = [(k, DAY + dt.timedelta(days=i), float(i)) for k, n in (("a", 60), ("b", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, day date, y double").withColumn("day", F.col("day").cast("timestamp"))
    out = jobs.run_forecast(df, "y", "ffill", keys=["key"], time_col="day", horizon=3, model="picky")
    said = {r["key"]: [w for w in r["warnings"] if "failed" in w] for r in out["facts"].collect()}
    assert said["b"] == [] and said["a"][-1] == "the forecast failed: ValueError: too long a past" and said["a"][0].startswith("fold ")
    assert out["forecast"].where("key = 'a' and step = 1").first()["yhat"] == 59.0


def test_logs_are_added_to(spark, tmp_path):
    rows = [(None if i % 2 else 1, i, float(i)) for i in range(40)]
    out = jobs.run_forecast(spark.createDataFrame(rows, "key int, at int, y double"), "y", "ffill", keys=["key"], time_col="at", horizon=2, model="naive")
    for _ in range(2):
        A.append_log(out["log"], str(tmp_path / "log"))
    log = A.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 2 * out["log"].count() == 10 and log.where("ts is null").count() == 0
    assert log.where("stage = 'series'").select(F.get_json_object("data", "$.series")).first()[0] == "2"


def test_rows_are_numbered_over_ranges_of_any_type(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 700).alias("x"))
    got = scan.ordered_numbers(df, [F.col("x")]).collect()
    assert sorted(r["pos"] for r in got) == list(range(3000))
    assert [r["x"] for r in sorted(got, key=lambda r: r["pos"])] == sorted(r["x"] for r in got)


def test_dotted_time_columns(spark):
    rows = [(DAY + dt.timedelta(days=i), f"2024-01-{i + 1:02d}", i, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "`a.day` date, `a.text` string, `a.n` int, y double")
    found = S.detect_time_columns(df, "y").collect()
    assert [(r["name"], r["kind"]) for r in found] == [("a.day", "datetime"), ("a.text", "parsed"), ("a.n", "ordered_int")]
    out = jobs.run_forecast(df, "y", "ffill", time_col="a.day", horizon=2, model="naive")
    assert [r["yhat"] for r in out["forecast"].collect()] == [19.0, 19.0]


def looped_holt(y, h, period):
    """Level, slope and seasons point by point; the first of factors whose error differs by rounding alone."""
    period = period if len(y) >= 2 * period else 1
    start = y[:period].mean()
    slope = (y[period : 2 * period].mean() - start) / period if period > 1 else y[min(1, len(y) - 1)] - y[0]
    found = []
    for alpha in (0.2, 0.5, 0.8):
        for beta in (0.05, 0.2):
            level, trend, loss, seasons = start, slope, 0.0, [v - start for v in y[:period]] if period > 1 else [0.0]
            for t in range(period, len(y)):
                error = y[t] - (level + trend + seasons[t % period])
                loss += error**2
                level, trend = level + trend + alpha * error, trend + alpha * beta * error
                seasons[t % period] += 0.3 * (1 - alpha) * error if period > 1 else 0.0
            found.append((loss, [level + i * trend + seasons[(len(y) - 1 + i) % period] for i in range(1, h + 1)]))
    least = min(loss for loss, _ in found) * (1 + 1e-9) + 1e-20 * float(y @ y)
    return next(answer for loss, answer in found if loss <= least)


def looped_smoothing(y, h):
    found = []
    for alpha in (0.1, 0.2, 0.35, 0.5, 0.75, 0.9):
        level, loss = y[0], 0.0
        for v in y[1:]:
            loss += (v - level) ** 2
            level += alpha * (v - level)
        found.append((loss, level))
    least = min(loss for loss, _ in found) * (1 + 1e-9) + 1e-20 * float(y @ y)
    return [next(level for loss, level in found if loss <= least)] * h


@pytest.mark.parametrize("n", [1, 2, 3, 8, 14, 63, 64, 65, 66, 129, 500])
def test_smoothing_by_blocks_is_smoothing_by_points(n):
    rng = np.random.default_rng(n)
    for y in (rng.normal(size=n).cumsum() + 5 * np.sin(np.arange(n)), np.full(n, 7.0), np.zeros(n), 1e6 + np.arange(n, dtype=float)):
        assert np.allclose(models.smoothing(y, 5), looped_smoothing(y, 5), rtol=1e-9, atol=1e-9)
        for period in (1, 4, 7, 24, 52):
            assert np.allclose(models.holt(y, 60, period), looped_holt(y, 60, period), rtol=1e-9, atol=1e-7)


def test_long_horizons_take_each_residual_once(spark):
    h, rng = 2000, np.random.default_rng(5)
    value = rng.normal(size=(3, h))
    rows = spark.createDataFrame([(f, s + 1, float(value[f, s])) for f in range(3) for s in range(h)], "fold int, step int, residual double")
    got = {r["step"]: (r["low"], r["high"]) for r in B.interval_offsets(rows, [], spark.createDataFrame([(h,)], "h int"), 0.8).collect()}
    assert sorted(got) == list(range(1, h + 1))
    for step in (1, 2, 17, 500, 1999, 2000):
        assert np.allclose(got[step], np.quantile(value[:, :step], [0.1, 0.9]))
    nan = spark.createDataFrame([(1, 1, 1.0), (2, 1, float("nan")), (3, 1, 0.0), (1, 3, 2.0)], "fold int, step int, residual double")
    some = {r["step"]: r["low"] for r in B.interval_offsets(nan, [], spark.createDataFrame([(3,)], "h int"), 1.0).collect()}
    assert some == {1: 0.0, 2: 0.0, 3: 0.0}
    assert B.interval_offsets(nan, [], spark.createDataFrame([(None,)], "h int")).count() == 0
