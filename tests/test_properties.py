"""Properties and golden cases: no leakage, whole series, exact explanations, round trips."""

import datetime as dt
import json
import math
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from augury.functions import forecasters
from augury.functions import text as G
from augury.operators import backtest as B
from augury.operators import evaluate as V
from augury.operators import prep as C
from augury.operators import profile as P
from augury.operators import ranks as R
from augury.operators import series as S
from augury.operators import train as T
from augury.plans import fixtures as X
from augury.plans import jobs
from augury.sources import tables as A
from augury.streaming import score as stream
from compare import DATA


def make_series(spark, values, start=dt.datetime(2021, 1, 1)):
    return spark.createDataFrame([(start + dt.timedelta(days=k), v) for k, v in enumerate(values)], "ds timestamp, y double")


def test_gaps_edges_and_runs(spark):
    values = [None, None] + [1.0, None, None, None, 5.0, None, 7.0, 8.0, None, None, None, 12.0] + [None, None]
    raw = S.regularize(make_series(spark, values), [], "D")
    trimmed = S.trim_edges(raw, [])
    assert {r["trimmed"] for r in trimmed.collect()} == {4} and trimmed.count() == 12
    assert sorted((r["start"], r["end"], r["length"]) for r in S.gap_runs(trimmed, []).collect()) == [(1, 3, 3), (5, 5, 1), (8, 10, 3)]
    filled = {s: [r["y"] for r in S.fill_gaps(trimmed, [], s).orderBy("pos").collect()] for s in S.STRATEGIES}
    assert filled["linear"] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert filled["ffill"][1:4] == [1, 1, 1] and filled["zero"][1] == 0 and filled["none"][1] is None and filled["mean"][1] == pytest.approx(33 / 5)
    audit = S.gap_audit(trimmed, S.fill_gaps(trimmed, [], "ffill"), [], "ffill").first()
    assert (audit["n_periods"], audit["n_observed"], audit["n_filled"], audit["longest_gap"], audit["warning"]) == (12, 5, 7, 3, "long gap")
    again = S.fill_gaps(S.fill_gaps(trimmed, [], "linear"), [], "linear")
    assert again.where("filled").count() == 0
    with pytest.raises(ValueError):
        S.fill_gaps(trimmed, [], "guess")


def test_monthly_series_keep_month_ends(spark):
    ends = [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31), dt.datetime(2024, 4, 30)]
    df = spark.createDataFrame([(e, float(k)) for k, e in enumerate(ends)], "ds timestamp, y double")
    assert S.frequency(df.withColumn("ds", F.date_trunc("month", "ds")), "ds", []).first()["freq"] == "M"
    assert S.regularize(df, [], "M").where("y is not null").count() == 4
    assert S.future_index(df.withColumn("pos", F.lit(0)), [], F.lit(1), "M").first()["ds"] == dt.datetime(2024, 5, 31)


def test_refuses_a_bad_target_and_a_runaway_grid(spark):
    df = make_series(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        S.validate_series(df.withColumn("y", F.lit("x")), "y", "ds", [])
    assert S.validate_series(df, "y", "ds", []).first()["status"] == "error"
    assert S.regularize(df, [], "H", max_periods=5).count() == 0
    assert S.runaway_series(df, [], "H", max_periods=5).count() == 1 and S.runaway_series(df, [], "D", max_periods=5).count() == 0


def test_origins(spark):
    size = spark.createDataFrame([(120, 12)], "n int, h int")
    assert [r["origin"] for r in B.backtest_origins(size, []).orderBy("fold").collect()] == [60, 72, 84, 96, 108]
    assert B.backtest_origins(spark.createDataFrame([(5, 4)], "n int, h int"), []).count() == 0


def test_backtest_sees_the_past_only_and_pads_short_answers(spark):
    y = [float(v) for v in range(60)]
    history = S.fill_gaps(S.trim_edges(S.regularize(make_series(spark, y), [], "D"), []), [], "none")
    B.register_forecaster("largest", lambda past, h: [float(np.max(past))])
    origins = B.backtest_origins(B.sizes(history, [], 6), [])
    got = B.backtest_model(history, [], origins, "largest").collect()
    start = {r["fold"]: r["origin"] for r in origins.collect()}
    assert len(got) == 30 and all(r["yhat"] == start[r["fold"]] - 1 for r in got)
    poisoned = history.withColumn("y", F.when(F.col("pos") >= 54, 1e9).otherwise(F.col("y")))
    early = lambda df: sorted((r["fold"], r["step"], r["yhat"]) for r in B.backtest_model(df, [], origins, "auto").where("fold < 5").collect())
    assert early(history) == early(poisoned)


def test_seasonal_beats_naive_on_a_season(spark):
    y = [10.0 + 5 * math.sin(2 * math.pi * k / 7) for k in range(140)]
    history = S.regularize(make_series(spark, y), [], "D")
    origins = B.backtest_origins(B.sizes(history, [], 14), [])
    naive, season = (B.backtest_metrics(B.backtest_baseline(history, [], origins, p), []).first()["mae"] for p in (None, 7))
    assert season < 1e-6 < naive
    rng = np.random.default_rng(0)
    sales = 100 + 1.2 * np.arange(140) + 8 * np.sin(2 * np.pi * np.arange(140) / 7) + rng.normal(0, 1, 140)
    assert np.abs(forecasters.auto(sales[:-14], 14) - sales[-14:]).mean() < 4


def test_forecast_by_key_equals_single_series(spark):
    days = X.daily_revenue(spark, DATA)
    options = {"time_col": "day", "horizon": 7, "seasonal_period": 7, "frequency": "D", "model": "seasonal_naive"}
    both = jobs.run_forecast(days, "revenue", "ffill", keys=X.KEYS, **options)["forecast"].where("o_orderpriority = '2-HIGH'")
    one = jobs.run_forecast(days.where("o_orderpriority = '2-HIGH'").drop("o_orderpriority"), "revenue", "ffill", **options)["forecast"]
    shape = lambda df: [(r["step"], r["ds"], round(r["yhat"], 6), round(r["lower"], 6)) for r in df.orderBy("step").collect()]
    assert shape(both) == shape(one) and len(shape(one)) == 7


def test_failing_model_leaves_the_naive_forecast(spark):
    def broken(past, h):
        raise RuntimeError

    B.register_forecaster("broken", broken)
    out = jobs.run_forecast(make_series(spark, [float(k) for k in range(50)]), "y", "none", time_col="ds", horizon=5, frequency="D", model="broken")
    assert {r["yhat"] for r in out["forecast"].collect()} == {49.0}
    facts = out["facts"].first()
    assert not facts["passed"] and facts["reasons"] == ["the model has no backtest score"]


def test_fit_uses_training_rows_only(spark):
    rows = X.lines(spark, DATA)
    split = C.split(rows, ["row_key"])
    poisoned = split.withColumn("l_quantity", F.when(F.col("is_train"), F.col("l_quantity")).otherwise(1e6)).withColumn("l_extendedprice", F.when(F.col("is_train"), F.col("l_extendedprice")).otherwise(1.0))
    roles = {"l_quantity": "numeric", "l_discount": "numeric", "p_brand": "text", "p_type": "categorical", "p_size": "numeric", "l_shipdate": "datetime"}
    fits = [C.fit_preparation(x, roles, {"p_brand": 25}, "l_extendedprice", "regression", ["row_key"]) for x in (split, poisoned)]
    (a, fa), (b, fb) = fits
    assert fa.fills == fb.fills and fa.features == fb.features
    assert all(fa.means["p_brand"][k] == pytest.approx(v) for k, v in fb.means["p_brand"].items())
    assert a.where("not is_train").count() == split.where("not is_train").count()
    assert set(fa.lineage.values()) == set(roles)


def test_replay_equals_preparation(spark):
    rows = C.split(X.lines(spark, DATA), ["row_key"])
    roles = {"l_quantity": "numeric", "l_discount": "numeric", "p_brand": "text", "p_type": "categorical", "p_size": "numeric", "l_shipdate": "datetime"}
    prepared, fit = C.fit_preparation(rows, roles, {"p_brand": 25}, "l_extendedprice", "regression", ["row_key"])
    again = C.transform_new(rows.where("not is_train"), fit, ["row_key"])
    shape = lambda df: df.select("row_key", *[F.round(c, 6) for c in fit.features]).orderBy("row_key", *fit.features).toPandas()
    pd.testing.assert_frame_equal(shape(prepared.where("not is_train")), shape(again))


def test_sanitize_and_targets(spark):
    assert C.sanitize_names(["a b", "a_b", "1x", "[<>]", "t:1", "y"], ["y"]) == {"a b": "a_b", "a_b": "a_b_2", "1x": "f_1x", "[<>]": "feature", "t:1": "t_1", "y": "y"}
    df = spark.createDataFrame([(1, "a", 2.0, "b")], "i int, s string, d double, z string")
    assert P.infer_target(df) == "d" and P.infer_target(df.select("s", "z")) == "z"


def test_coercion(spark):
    df = spark.createDataFrame([("$10,300", "51,000 mi.", "5,144", "<1H OCEAN", "-3.5%"), ("$9,000.50", "900 mi.", "77", "INLAND", None)], "price string, mileage string, area string, ocean string, rate string")
    got = P.coerce_numeric_like(df).collect()
    assert [tuple(r) for r in got] == [(10300.0, 51000.0, 5144.0, "<1H OCEAN", -3.5), (9000.5, 900.0, 77.0, "INLAND", None)]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 2.5, None)], "a int, b double, c string")
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    back = A.read_table(spark, str(tmp_path / "csv"))
    assert sorted((r["a"], r["b"]) for r in back.fillna({"b": -1.0}).collect()) == [(1, -1.0), (2, 2.5)]
    assert A.normalise(df).where("b is null").count() == 1
    fit = C.Fit("y", "regression", ["f"], fills={"f": 1.5}, means={"f": {"u": 2.0}})
    A.save_fit(fit, spark, str(tmp_path / "fit"))
    assert A.load_fit(C.Fit, spark, str(tmp_path / "fit")) == fit
    A.write_results({"t": df, "m": df.select(F.lit("# text").alias("markdown"))}, str(tmp_path / "out"), keys=["a"])
    assert spark.read.parquet(str(tmp_path / "out" / "t")).count() == 2 and spark.read.text(str(tmp_path / "out" / "m")).count() == 2
    log = A.run_log(spark, [("split", "rows", "by hash", "{}", "ok", dt.datetime(2024, 1, 1)), ("fit", "drop", None, "{}", "warn", dt.datetime(2024, 1, 2))])
    assert [r[0] for r in log.orderBy("ts").select(A.pretty_line(F.col("stage"), F.col("action"), F.col("status"), F.col("reason"))).collect()] == ["[split] rows — by hash", "[fit] drop [warn]"]


def test_training_scoring_and_streaming(spark, tmp_path):
    out = jobs.run_tabular(X.priced_lines(spark, DATA), ["row_key"], "l_extendedprice", most_attempts=1, families=["linear", "boosted"])
    facts = out["facts"].first()
    assert facts["task"] == "regression" and facts["score"] > 0.8 and facts["passed"] and facts["cv_mean"] > 0.8
    A.append_log(out["log"], str(tmp_path / "log"))
    log = {r["stage"]: r for r in A.read_log(spark, str(tmp_path / "log")).collect()}
    assert list(log["training"])[1] == facts["family"] and json.loads(log["training"]["data"])["features"] == len(out["fit"].features)
    assert log["gate"]["status"] == "ok" and log["gate"]["reason"] is None and json.loads(log["gate"]["data"])["confidence"] == facts["confidence"]
    fit, model = out["fit"], out["trained"].model
    rows = X.priced_lines(spark, DATA)
    scored = T.score(rows, fit, model, ["row_key"])
    A.save_fit(out["trained"], spark, str(tmp_path / "trained"))
    again = A.load_fit(T.Trained, spark, str(tmp_path / "trained"))
    assert again.family == out["trained"].family and T.score(rows, fit, again.model, ["row_key"]).exceptAll(scored).count() == 0
    assert scored.count() == rows.count() and scored.where("prediction is null").count() == 0
    rows.write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream.write_scores(stream.score_stream(lines, fit, model, ["row_key"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
    importance = T.shap_importance(out["prepared"], fit, model, str(tmp_path / "model"))
    assert importance.orderBy("rank").first()["feature"] == "l_quantity"
    report = jobs.explanation_report(out["facts"], importance).first()["report"]
    assert '"recommendation"' in report and '"l_quantity"' in report


def test_classification(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "lang", "n_chars", (F.length(F.regexp_replace("text", "[^#*$%&|!]", "")) / F.length("text")).alias("signs"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality"))
    out = jobs.run_tabular(rows, ["doc_id"], "quality", most_attempts=1, families=["tree"])
    facts = out["facts"].first()
    assert facts["task"] == "classification" and facts["score"] > 0.7
    assert {r["prediction"] for r in T.score(rows, out["fit"], out["trained"].model, ["doc_id"]).collect()} <= {"good", "bad"}


def exhaustive_shap(leaves: list, x: np.ndarray, n: int) -> np.ndarray:
    """Shapley values by all subsets, to check ``tree_shap``."""

    def game(subset: frozenset) -> float:
        return sum(value * np.prod([(float(low < x[f] <= high) if f in subset else share) for f, low, high, share in path]) for value, path in leaves)

    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for s in combinations(others, size):
                phi[i] += factorial(size) * factorial(n - size - 1) / factorial(n) * (game(frozenset(s) | {i}) - game(frozenset(s)))
    return phi


def test_tree_shap_is_exact_and_additive(spark, tmp_path):
    prepared, fit = C.fit_preparation(C.split(X.lines(spark, DATA), ["row_key"]), {"l_quantity": "numeric", "l_discount": "numeric", "p_brand": "text", "p_type": "text", "p_size": "numeric", "l_shipdate": "datetime"}, {"p_brand": 25, "p_type": 6}, "l_extendedprice", "regression", ["row_key"])
    rows = T.assembled(prepared.where("is_train"), fit.features, fit.target)
    for name in ("tree", "forest", "boosted"):
        model = T.candidates("regression", 0, 4, 3, 1)[name].fit(rows)
        sample = model.transform(rows.limit(5)).collect()
        x = np.array([r["features"].toArray() for r in sample])
        trees = [(w, T._leaves(nodes, None)) for w, nodes in T._trees(model, str(tmp_path / name), spark)]
        phi = sum(w * T.tree_shap(leaves, x) for w, leaves in trees)
        base = sum(w * T.expected_value(leaves) for w, leaves in trees)
        assert np.allclose(phi.sum(1) + base, [r["prediction"] for r in sample])
        assert np.allclose(T.tree_shap(trees[0][1], x)[0], exhaustive_shap(trees[0][1], x[0], x.shape[1]))


def test_number_checks(spark):
    texts = spark.createDataFrame([("a", "gains of 46 % on 2017-05-01"), ("a", "it was 23.7 and 5000"), ("b", "no number")], "id string, text string")
    allowed = spark.createDataFrame([("a", 46.18)], "id string, value double")
    got = {r["id"]: r for r in G.validate_numbers(texts.where("text not like '%23.7%'"), allowed, ["id"], "text").collect()}
    assert got["a"]["verdict"] == "VERIFIED" and got["b"]["n_numbers"] == 0
    bad = G.validate_numbers(texts.where("text like '%23.7%'"), allowed, ["id"], "text").first()
    assert bad["n_ungrounded"] == 2 and bad["ungrounded"] == "23.7, 5000"
    found = [r["token"] for r in G.extract_numbers(texts.where("id = 'a' and text like '%2017%'"), ["id"], "text").collect()]
    assert found == ["46"]


@pytest.mark.parametrize("text, intent", [("Forecast the next month", "forecast"), ("why did it fall", "explanation"), ("predict the price", "prediction"), ("hello", "unknown"), ("توقع المبيعات", "prediction"), ("توقع المبيعات القادمة", "forecast"), ("لماذا", "explanation"), ("a trendy house, predict it", "prediction"), (None, "unknown")])
def test_intents(spark, text, intent):
    assert spark.createDataFrame([(text,)], "t string").select(G.label_intent(F.col("t"))).first()[0] == intent


def test_select_required(spark):
    rows = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 0.5), ("d", 0.5)], "raw string, importance double")
    assert {r["raw"] for r in V.select_required(rows).where("required").collect()} == {"a", "b", "c"}
    assert V.select_required(rows.withColumn("importance", F.lit(0.0))).where("required").count() == 4


def test_required_by_correlation(spark):
    rows = spark.createDataFrame([("a", 0.0, 2), ("b", 0.0, 1), ("c", 0.0, 3), ("d", 0.0, 4)], "raw string, importance double, position int")
    corr = spark.createDataFrame([("a", -0.8), ("b", 0.8), ("c", 0.4)], "column string, corr double")
    got = V.select_required(rows, correlations=corr).orderBy("rank").collect()
    assert [r["raw"] for r in got] == ["b", "a", "c", "d"] and [r["required"] for r in got] == [True, True, True, False]
    assert got[0]["covered"] == 1.0
    assert V.select_required(rows.withColumn("importance", F.lit(0.0)), correlations=corr.where("false")).where("required").count() == 4


def test_every_series_ends_somewhere(spark):
    """Daily, monthly, short, tiny and runaway series: a forecast with its own frequency, or a status that says why not."""
    day = lambda k: dt.datetime(2021, 1, 1) + dt.timedelta(days=k)
    rows = [("daily", day(k), float(k % 7)) for k in range(60)] + [("monthly", dt.datetime(2015 + k // 12, k % 12 + 1, 1), float(k)) for k in range(40)]
    rows += [("short", day(k), float(k)) for k in range(20)] + [("tiny", day(k), 1.0) for k in range(2)] + [("runaway", day(k if k < 8 else 20_000), 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "k string, ds timestamp, y double")
    out = jobs.run_forecast(df, "y", "ffill", keys=["k"], time_col="ds", horizon=14, model="naive", max_periods=5000)
    status = {r["k"]: (r["status"], r["error"]) for r in out["status"].collect()}
    assert {k: s for k, (s, _) in status.items()} == {"daily": "ok", "monthly": "ok", "short": "no backtest", "tiny": "error", "runaway": "error"}
    assert "needed" in status["short"][1] and "too many" in status["runaway"][1]
    facts = {r["k"]: r for r in out["facts"].collect()}
    assert facts["monthly"]["freq"] == "M" and facts["daily"]["freq"] == "D" and facts["monthly"]["n"] == 40 and not facts["short"]["passed"]
    steps = {r["k"]: r["count"] for r in out["forecast"].groupBy("k").count().collect()}
    assert steps == {"daily": 14, "monthly": 14, "short": 14}
    bare = out["forecast"].where("k = 'short'").collect()
    assert all(r["lower"] == r["yhat"] == r["upper"] == 19.0 for r in bare)
    nothing = jobs.run_forecast(df.where("k = 'tiny'"), "y", "ffill", keys=["k"], time_col="ds", horizon=2, model="naive")
    assert nothing["forecast"].count() == 0 and nothing["status"].first()["status"] == "error"
    text = df.where("k = 'daily'").withColumn("ds", F.date_format("ds", "dd/MM/yyyy")).withColumn("note", F.lit("x"))
    moved = jobs.run_forecast(text, "y", "ffill", keys=["k"], time_col="note", horizon=3, model="naive")
    assert moved["forecast"].count() == 3 and "note is no time axis; ds is used" in moved["facts"].first()["warnings"]


def test_many_classes_and_dotted_names(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 250).alias("x.y"), F.concat(F.lit("c"), (F.col("id") % 250).cast("string")).alias("label"))
    split = C.split(rows.withColumnRenamed("x.y", "x"), ["id"], stratify="label")
    prepared, fit = C.fit_preparation(split, {"x": "numeric"}, {}, "label", "classification", ["id"])
    assert len(fit.classes) == 250 and prepared.where("label < 0").count() == 0 and prepared.select("label").distinct().count() == 250
    texts = split.withColumn("t", F.concat(F.lit("t"), F.col("id")))
    with pytest.raises(ValueError, match="more than 200 values"):
        C.fit_preparation(texts, {"x": "numeric"}, {}, "label", "classification", ["id"])
    assert P.duplicate_rows(rows).first()[0] == 0 and P.numeric_stats(rows, ["x.y"]).first()["max"] == 249
    assert {r["column"] for r in P.profile_columns(rows).collect()} == {"id", "x.y", "label"} and P.profile_warnings(rows).count() == 1


def test_classes_of_any_size_are_split_exactly(spark):
    label = F.when(F.col("id") < 2000, "big").when(F.col("id") < 2100, "small")
    rows = spark.range(3100).select("id", label.alias("c"))
    got = {r["c"]: r["n"] for r in C.split(rows, ["id"], stratify="c").where("not is_train").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {"big": 400, "small": 20, None: 200}
    code = F.md5(F.col("id").cast("string"))
    for prefix in (0, 1, 4):
        placed = C.class_places(rows, "c", code, prefix).withColumn("code", code).toPandas()
        for _, own in placed.groupby("c", dropna=False):
            assert own.sort_values("code")["_place"].tolist() == list(range(1, len(own) + 1)) and set(own["_n"]) == {len(own)}


def test_thousands_of_classes_train_and_score(spark):
    rows = spark.range(10_000).select("id", (F.col("id") % 5000).cast("double").alias("x"), F.concat(F.lit("c"), F.lpad((F.col("id") % 5000).cast("string"), 4, "0")).alias("label"))
    prepared, fit = C.fit_preparation(C.split(rows, ["id"], stratify="label"), {"x": "numeric"}, {}, "label", "classification", ["id"])
    assert len(fit.classes) == 5000 and prepared.select("label").distinct().count() == 5000
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    held = T.assembled(prepared.where("is_train"), fit.features, fit.target, ["id"], len(fit.classes))
    model = PipelineModel([VectorAssembler(inputCols=fit.features, outputCol="features"), DecisionTreeClassifier(labelCol="label", maxDepth=3).fit(held)])
    scored = T.score(rows, fit, model, ["id"])
    assert scored.count() == 10_000 and scored.where("prediction is null or prediction not rlike '^c[0-9]{4}$'").count() == 0


def test_holt_winters_follows_trend_and_season():
    y = np.array([10 + 0.5 * k + [0, 3, -2, 5][k % 4] for k in range(40)])
    want = np.array([10 + 0.5 * k + [0, 3, -2, 5][k % 4] for k in range(40, 46)])
    assert np.abs(forecasters.holt(y, 6, 4) - want).max() < 1.5 and len(forecasters.holt(np.array([1.0]), 3)) == 3


def test_quality_audit(spark):
    out = jobs.quality_audit(X.text_numbers(spark, DATA))
    assert {r["column"]: r["dtype"] for r in out["profile"].collect()}["price"] == "float"
    assert out["coercion"].count() >= 2 and out["warnings"].count() == 1


def test_coercion_impact_and_attempts(spark):
    rows = X.priced_lines(spark, DATA).withColumn("p_size", F.concat(F.col("p_size").cast("string"), F.lit("Story")))
    got = {r["pattern"]: r for r in jobs.coercion_impact(rows, ["row_key"], "l_extendedprice", most_attempts=1, families=["tree"]).collect()}
    assert set(got) == {"number_like", "units_only"} and got["number_like"]["score"] > 0.5
    noise = X.priced_lines(spark, DATA).withColumn("l_extendedprice", F.rand(3))
    out = jobs.run_tabular(noise, ["row_key"], "l_extendedprice", most_attempts=2, families=["linear"])
    facts = out["facts"].first()
    assert facts["attempts"] == 2 and not facts["passed"] and facts["reasons"][0] == "R2 is too low"
    assert {(r["status"], r["reason"]) for r in out["log"].where("stage = 'gate'").collect()} == {("warn", "; ".join(facts["reasons"]))}


@pytest.mark.parametrize("values", [[], [None, float("nan")], [4.0], [1.0, 2.0, 2.0, 2.0, 9.0, None, -3.5], [float(k * k % 977) for k in range(3000)]])
def test_exact_quantiles_are_those_of_the_whole_column(spark, values):
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    known = [v for v in values if v is not None and not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    found = R.exact_quantiles(rows, {"a": F.col("v"), "b": -F.col("v")}, shares)
    assert found["a"] == (pytest.approx(np.quantile(known, shares)) if known else [None] * 6)
    assert found["b"] == (pytest.approx(np.quantile([-v for v in known], shares)) if known else [None] * 6)


def test_quantiles_hold_when_the_sketch_is_far_off(spark, monkeypatch):
    monkeypatch.setattr(R, "ACCURACY", 10)
    values = [float(k % 1013) ** 2 for k in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    assert R.exact_quantiles(rows, {"v": F.col("v")}, [0.01, 0.5, 0.77])["v"] == pytest.approx(np.quantile(values, [0.01, 0.5, 0.77]))


def test_rows_are_numbered_in_order_over_many_buckets(spark):
    rows = spark.range(2000).select((F.col("id") * 7919 % 2003 - 1000).alias("x"), F.col("id").alias("pos_2"))
    got = [(r["pos"], r["x"]) for r in R.numbered(rows, "x", buckets=50).orderBy("pos").collect()]
    assert [p for p, _ in got] == list(range(2000)) and [x for _, x in got] == sorted(r["x"] for r in rows.collect())
    ties = spark.createDataFrame([(1,), (1,), (0,), (1,)], "x int")
    assert sorted(r["pos"] for r in R.numbered(ties, "x").collect()) == [0, 1, 2, 3]
    assert R.numbered(ties.where("x > 5"), "x").count() == 0


def test_modes_and_fills_of_whole_columns(spark):
    rows = spark.createDataFrame([(1.0, "b", True), (None, "a", True), (3.0, "b", True), (8.0, "a", True), (99.0, None, False)], "n double, t string, is_train boolean")
    assert C.fit_imputer(rows, ["n", "t"]) == {"n": 3.0, "t": "a"}
    empty = rows.where("n is null and t is null")
    assert C.fit_imputer(empty, ["n", "t"]) == {} and C.fit_imputer(rows.where("t is null"), ["n", "t"]) == {"t": "unknown"}


def test_band_offsets_are_quantiles_of_the_steps_so_far(spark):
    rng = np.random.default_rng(3)
    rows = [("a", f, s, float(v)) for f in range(3) for s, v in zip(range(1, 7), rng.normal(size=6), strict=True)] + [("b", 1, 3, 2.0), ("b", 1, 4, None), ("c", 1, 1, None)]
    residuals = spark.createDataFrame(rows, "k string, fold int, step int, residual double")
    sizes = spark.createDataFrame([("a", 6), ("b", 4), ("c", 2), ("d", 2)], "k string, h int")
    got = {(r["k"], r["step"]): (r["low"], r["high"]) for r in B.interval_offsets(residuals, ["k"], sizes, 0.8).collect()}
    want = {("a", h): tuple(np.quantile([v for k, _, s, v in rows if k == "a" and s <= h], [0.1, 0.9])) for h in range(1, 7)} | {("b", 3): (2.0, 2.0), ("b", 4): (2.0, 2.0)}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k]) for k in want)
    alone = B.interval_offsets(residuals.where("k = 'a'").drop("k"), [], spark.createDataFrame([(6,)], "h int")).collect()
    assert {r["step"]: (r["low"], r["high"]) for r in alone} == {h: got["a", h] for h in range(1, 7)}
    assert B.interval_offsets(residuals.where("false").drop("k"), [], spark.createDataFrame([(6,)], "h int")).count() == 0
