"""Registered queries of the series and backtest operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import backtest as B
from augury.operators import series as S
from augury.plans import fixtures as X

K = X.KEYS
H = 14
SQL_DAY = "strftime(ds, '%Y-%m-%d') AS ds"


def _day():
    return F.date_format("ds", "yyyy-MM-dd").alias("ds")


def _r(name: str, places: int = 4):
    return F.round(name, places).alias(name)


def _shaped(df):
    return df.select(*K, "pos", _day(), _r("y"))


def detect_axis(spark, sf):
    o = X.table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 40 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    found = S.detect_time_columns(o.select("o_orderdate", text.alias("as_text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), "o_orderkey", "o_totalprice"), "o_totalprice")
    return found.select("name", "kind", _r("parse_rate", 2), "rank")


def origins(spark, sf):
    return B.backtest_origins(B.sizes(X.filled(spark, sf), K, H), K)


def scored(spark, sf, period=None):
    f = X.filled(spark, sf)
    return B.backtest_baseline(f, K, B.backtest_origins(B.sizes(f, K, H), K), period)


ORIGINS = X.FILLED + f", sizes AS (SELECT o_orderpriority, count(*) AS n, {H} AS h FROM filled GROUP BY 1), spans AS (SELECT *, greatest(h, n // 2) AS least, n - h AS last FROM sizes), origins AS (SELECT o_orderpriority, origin, h, row_number() OVER (PARTITION BY o_orderpriority ORDER BY origin) AS fold FROM (SELECT DISTINCT o_orderpriority, CAST(round_even(least + i * (last - least) / 4.0, 0) AS BIGINT) AS origin, h FROM spans, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE last > least) WHERE true)"


def _scored(period: int | None, name: str) -> str:
    back = "origin - 1" if not period else f"CASE WHEN origin < {period} THEN origin - 1 ELSE origin - {period} + (step - 1) % {period} END"
    return f", {name} AS (SELECT o.o_orderpriority, fold, step, a.pos, a.y, b.y AS yhat FROM (SELECT *, {back} AS back FROM (SELECT *, unnest(generate_series(1, h)) AS step FROM origins)) o JOIN filled a ON a.o_orderpriority = o.o_orderpriority AND a.pos = origin + step - 1 JOIN filled b ON b.o_orderpriority = o.o_orderpriority AND b.pos = back)"


BASE, SEASON = ORIGINS + _scored(None, "base"), ORIGINS + _scored(7, "season")
BOTH = ORIGINS + _scored(None, "base") + _scored(7, "season")
METRICS = "avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, 100 * avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) AS mape, count(DISTINCT fold) AS n_folds, count(y - yhat) AS n_scored"
COMPARE = BOTH + ", bm AS (SELECT o_orderpriority, avg(abs(y - yhat)) AS naive_mae FROM base GROUP BY 1), sm AS (SELECT o_orderpriority, avg(abs(y - yhat)) AS model_mae FROM season GROUP BY 1), cmp AS (SELECT bm.o_orderpriority, model_mae, naive_mae, coalesce(model_mae < naive_mae, false) AS beats_naive, CASE WHEN naive_mae <> 0 THEN round((naive_mae - model_mae) / naive_mae * 100, 2) END AS improvement_pct FROM bm LEFT JOIN sm ON bm.o_orderpriority = sm.o_orderpriority)"
COVER = COMPARE + ", res AS (SELECT o_orderpriority, fold, step, y - yhat AS residual FROM season), band AS (SELECT o_orderpriority, quantile_cont(residual, 0.1) AS lo, quantile_cont(residual, 0.9) AS hi FROM res GROUP BY 1), cov AS (SELECT r.o_orderpriority, avg(CASE WHEN residual BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0.0 END) AS coverage FROM res r JOIN band b ON r.o_orderpriority = b.o_orderpriority GROUP BY 1)"
OBS = ", obs AS (SELECT o_orderpriority, count(y) AS n_observed FROM filled GROUP BY 1)"
GATED = COVER + OBS + ", facts AS (SELECT c.*, coverage, n_observed FROM cmp c JOIN cov ON c.o_orderpriority = cov.o_orderpriority JOIN obs ON c.o_orderpriority = obs.o_orderpriority), gated AS (SELECT *, model_mae IS NOT NULL AND (naive_mae IS NULL OR model_mae < naive_mae) AS passed, concat_ws('; ', CASE WHEN model_mae IS NULL THEN 'the model has no backtest score' END, CASE WHEN NOT model_mae < naive_mae THEN 'the model does not beat the naive baseline' END) AS reasons, concat_ws('; ', CASE WHEN abs(coverage - 0.8) > 0.15 THEN 'interval coverage is far from its level' END) AS warnings, round(0.5 * least(greatest(coalesce(improvement_pct / 50, 0), 0), 1) + 0.3 * coalesce(greatest(0, 1 - abs(coverage - 0.8) / 0.8), 0.5) + 0.2 * least(greatest(n_observed / 100, 0), 1), 3) AS confidence FROM facts)"
LABEL = "CASE WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.4 THEN 'Medium' ELSE 'Low' END AS confidence_label"
OFFSETS = COVER + f", off AS (SELECT o_orderpriority, step, quantile_cont(residual, 0.1) AS low, quantile_cont(residual, 0.9) AS high FROM (SELECT o_orderpriority, residual, unnest(generate_series(step, {H})) AS step FROM res) GROUP BY 1, 2)"
POINT = f", pt AS (SELECT s.o_orderpriority, s.step, f.y AS yhat, last_ds + s.step * INTERVAL 1 DAY AS ds FROM (SELECT o_orderpriority, n, last_ds, unnest(generate_series(1, {H})) AS step FROM (SELECT o_orderpriority, count(*) AS n, max(ds) AS last_ds FROM filled GROUP BY 1)) s JOIN filled f ON f.o_orderpriority = s.o_orderpriority AND f.pos = CASE WHEN n < 7 THEN n - 1 ELSE n - 7 + (s.step - 1) % 7 END)"


def compared(spark, sf):
    a, b = scored(spark, sf, 7), scored(spark, sf)
    return B.compare_to_naive(B.backtest_metrics(a, K), B.backtest_metrics(b, K), K)


def residuals(spark, sf):
    return B.residuals_by_step(scored(spark, sf, 7), K)


def facts(spark, sf):
    cover = B.interval_coverage(residuals(spark, sf), K)
    seen = B.sizes(X.filled(spark, sf), K, H).select(*K, "n_observed")
    return B.forecast_confidence(B.forecast_gate(compared(spark, sf).join(cover, K).join(seen, K)))


def _facts(spark, sf, *columns):
    f = facts(spark, sf)
    return f.withColumns({c: F.concat_ws("; ", c) for c in ("reasons", "warnings")}).select(*K, *columns)


def bands(spark, sf):
    f = X.filled(spark, sf)
    point = B.seasonal_naive(f, K, H, 7)
    return B.prediction_intervals(point, residuals(spark, sf), K, B.sizes(f, K, H))


def statuses(spark, sf):
    """The orders of each customer, in their order, as a series, and what became of it: forecast, no backtest or error.  Orders of
    every seventh customer have no key and are one series."""
    from augury.plans.jobs import run_forecast

    orders = X.table(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))
    out = run_forecast(orders, "o_totalprice", "ffill", keys=["o_custkey"], time_col="o_orderkey", horizon=2, model="naive")
    got = out["forecast"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_steps"))
    return B._on(out["status"], got, ["o_custkey"], how="left").select("o_custkey", "status", F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def run_forecast_naive(spark, sf):
    """Flagship: series by priority to forecast, bands, gate and confidence, with the seasonal baseline as model."""
    from augury.plans.jobs import run_forecast

    out = run_forecast(X.daily_revenue(spark, sf), "revenue", "ffill", keys=K, time_col="day", horizon=H, seasonal_period=7, frequency="D", model="seasonal_naive")
    return out["forecast"].select(*K, "step", _day(), *[_r(c, 5) for c in ("yhat", "lower", "upper")], "passed", F.round("improvement_pct", 2).alias("improvement_pct"), "confidence_label")


def whole(spark, sf):
    """Revenue a day of all orders, a single series without keys; every eleventh day of the year is unobserved."""
    days = X.table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("revenue"))
    return days.withColumn("revenue", F.when(F.dayofyear("day") % 11 != 0, F.round("revenue", 2)))


def whole_trimmed(spark, sf):
    return S.trim_edges(S.regularize(S.collapse_duplicates(whole(spark, sf), [], "day", "revenue"), [], "D"), [], PART)


def whole_filled(spark, sf, strategy="ffill"):
    return S.fill_gaps(whole_trimmed(spark, sf), [], strategy, PART)


def whole_backtest(spark, sf):
    """Five folds of a single series, each in a task of its own, with the mean of the last week; a history of an even number of
    days is refused, and what was said is kept."""

    def last_week(past, h):
        if len(past) % 2 == 0:
            raise ValueError(f"{len(past)} days")
        return [float(past[-7:].mean())] * h

    B.register_forecaster("odd_week", last_week)
    f = whole_filled(spark, sf)
    got = B.backtest_model(f, [], B.backtest_origins(B.sizes(f, [], H), []), "odd_week")
    return got.groupBy("fold").agg(F.count("yhat").alias("n_scored"), F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 2).alias("mae"), F.max("note").alias("note"))


def forecast_log(spark, sf):
    """What the stages of the flagship job did."""
    from augury.plans.jobs import run_forecast

    out = run_forecast(X.daily_revenue(spark, sf), "revenue", "ffill", keys=K, time_col="day", horizon=H, seasonal_period=7, frequency="D", model="seasonal_naive")
    return out["log"].drop("ts")


PART = 97  # rows of a part in the queries of a single series, so that it has many

REGULARITY = "gaps AS (SELECT o_orderpriority, epoch(ds) - epoch(lag(ds) OVER (PARTITION BY o_orderpriority ORDER BY ds)) AS gap FROM points)"


def queries() -> dict:
    t = X.table
    return {
        "detect_time_columns": detect_axis,
        "series_regularity": lambda s, d: S.frequency(X.daily_revenue(s, d), "day", K).select(*K, "n_stamps", _r("regularity"), "freq"),
        "validate_series_input": lambda s, d: S.validate_series(t(s, d, "orders"), "o_totalprice", "o_orderdate", ["o_custkey"]),
        "collapse_duplicates": lambda s, d: S.collapse_duplicates(t(s, d, "orders"), K, "o_orderdate", "o_totalprice").select(*K, _day(), _r("y")),
        "regularize": lambda s, d: _shaped(X.on_grid(s, d)),
        "regularize_monthly_buckets": lambda s, d: _shaped(S.regularize(S.collapse_duplicates(t(s, d, "orders"), K, "o_orderdate", "o_totalprice"), K, "M", "bucket")),
        "integer_series": lambda s, d: S.integer_series(X.customers_orders(s, d), [], "o_orderkey", "price").select("pos", "ds", "y"),
        "default_horizon": lambda s, d: B.sizes(X.filled(s, d), K).select(*K, "n_observed", "h"),
        "trim_edges": lambda s, d: _shaped(X.trimmed(s, d)),
        "gap_runs": lambda s, d: S.gap_runs(X.trimmed(s, d), K),
        **{f"fill_gaps_{x}": (lambda s, d, x=x: X.filled(s, d, x).select(*K, "pos", _r("y", 6), "filled")) for x in S.STRATEGIES},
        "gap_audit": lambda s, d: S.gap_audit(X.trimmed(s, d), X.filled(s, d), K, "ffill"),
        "future_index": lambda s, d: S.future_index(X.filled(s, d), K, F.lit(H), "D").select(*K, "step", _day()),
        "naive": lambda s, d: B.naive(X.filled(s, d), K, H),
        "seasonal_naive": lambda s, d: B.seasonal_naive(X.filled(s, d), K, H, 7),
        "backtest_origins": lambda s, d: origins(s, d).select(*K, "fold", "origin"),
        "backtest_naive": lambda s, d: scored(s, d).select(*K, "fold", "step", "pos", _r("y"), _r("yhat")),
        "backtest_seasonal_naive": lambda s, d: scored(s, d, 7).select(*K, "fold", "step", "pos", _r("y"), _r("yhat")),
        "backtest_metrics_by_fold": lambda s, d: B.backtest_metrics(scored(s, d), [*K, "fold"]).select(*K, "fold", *[_r(c, 2) for c in ("mae", "rmse", "mape")], "n_scored"),
        "backtest_metrics_pooled": lambda s, d: B.backtest_metrics(scored(s, d), K).select(*K, *[_r(c, 2) for c in ("mae", "rmse", "mape")], "n_folds", "n_scored"),
        "residuals_by_step": lambda s, d: residuals(s, d).select(*K, "fold", "step", _r("residual", 2)),
        "compare_to_naive": lambda s, d: compared(s, d).select(*K, _r("model_mae", 2), _r("naive_mae", 2), "beats_naive", "improvement_pct"),
        "prediction_intervals": lambda s, d: bands(s, d).select(*K, "step", *[_r(c, 5) for c in ("yhat", "lower", "upper")]),
        "interval_coverage": lambda s, d: B.interval_coverage(residuals(s, d), K).select(*K, _r("coverage")),
        "forecast_gate": lambda s, d: _facts(s, d, "passed", "reasons", "warnings"),
        "forecast_confidence": lambda s, d: _facts(s, d, "confidence", "confidence_label"),
        "run_forecast_naive": run_forecast_naive,
        "run_forecast_status": statuses,
        "run_forecast_log": forecast_log,
        "single_series_regularity": lambda s, d: S.frequency(whole(s, d), "day", [], PART).select("n_stamps", _r("regularity"), "freq"),
        "single_series_stamps": lambda s, d: S.regularize(S.collapse_duplicates(whole(s, d), [], "day", "revenue"), [], None).select("pos", _day(), _r("y")),
        "single_series_gap_runs": lambda s, d: S.gap_runs(whole_trimmed(s, d), [], PART),
        **{f"single_series_{x}": (lambda s, d, x=x: whole_filled(s, d, x).select("pos", _day(), _r("y", 5), "filled")) for x in ("ffill", "linear", "mean")},
        "single_series_audit": lambda s, d: S.gap_audit(whole_trimmed(s, d), whole_filled(s, d), [], "ffill", PART),
        "single_series_backtest": whole_backtest,
    }


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, q: f"WITH {ctes} {q}"
    key = "o_orderpriority"
    fill = {
        "none": "y", "zero": "coalesce(y, 0)", "mean": f"coalesce(y, avg(y) OVER (PARTITION BY {key}))", "ffill": "coalesce(y, y0)",
        "linear": "coalesce(y, y0 + (y1 - y0) * (pos - p0) / (p1 - p0))",
    }
    filled = {}
    for name, expr in fill.items():
        inner = "SELECT *, last_value(y IGNORE NULLS) OVER back AS y0, first_value(y IGNORE NULLS) OVER ahead AS y1, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS p0, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS p1 FROM trimmed WINDOW back AS (PARTITION BY o_orderpriority ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY o_orderpriority ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        filled[f"fill_gaps_{name}"] = w(X.TRIM, f"SELECT {key}, pos, round({expr}, 6) AS y, y IS NULL AND ({expr}) IS NOT NULL AS filled FROM ({inner})")
    one = "daily AS (SELECT o_orderdate AS ds, CASE WHEN dayofyear(o_orderdate) % 11 <> 0 THEN round(sum(o_totalprice), 2) END AS y FROM orders GROUP BY 1)"
    one_trim = (
        one + ", grid AS (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM daily), placed AS (SELECT g.ds, y FROM grid g LEFT JOIN daily d ON d.ds = g.ds)"
        ", ends AS (SELECT min(ds) FILTER (y IS NOT NULL) AS lo, max(ds) FILTER (y IS NOT NULL) AS hi, count(*) AS n FROM placed)"
        ", trimmed AS (SELECT row_number() OVER (ORDER BY ds) - 1 AS pos, ds, y, n - (date_diff('day', lo, hi) + 1) AS trimmed FROM placed, ends WHERE ds BETWEEN lo AND hi)"
        ", around AS (SELECT *, last_value(y IGNORE NULLS) OVER back AS y0, first_value(y IGNORE NULLS) OVER ahead AS y1, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS p0, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS p1"
        " FROM trimmed WINDOW back AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
        ", runs AS (SELECT min(pos) AS start, max(pos) AS \"end\", count(*) AS length FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS island FROM trimmed WHERE y IS NULL) GROUP BY island)"
    )
    folds = f", size AS (SELECT count(*) AS n FROM around), spans AS (SELECT greatest({H}, n // 2) AS least, n - {H} AS last FROM size), origins AS (SELECT origin, row_number() OVER (ORDER BY origin) AS fold FROM (SELECT DISTINCT CAST(round_even(least + i * (last - least) / 4.0, 0) AS BIGINT) AS origin FROM spans, (SELECT unnest([0, 1, 2, 3, 4]) AS i)))"
    value = {"ffill": "coalesce(y, y0)", "linear": "coalesce(y, y0 + (y1 - y0) * (pos - p0) / (p1 - p0))", "mean": "coalesce(y, avg(y) OVER ())"}
    count = lambda what: f"sum(CAST({what} AS INT))"
    single = {
        "single_series_regularity": w(one + ", gaps AS (SELECT epoch(ds) - epoch(lag(ds) OVER (ORDER BY ds)) AS gap FROM daily)", "SELECT count(*) AS n_stamps, round(1 - least(1.0::DOUBLE, stddev_pop(gap) / (avg(gap) + 1e-9)), 4) AS regularity, CASE WHEN quantile_cont(gap, 0.5) <= 43200 THEN 'H' WHEN quantile_cont(gap, 0.5) <= 129600 THEN 'D' ELSE 'W' END AS freq FROM gaps"),
        "single_series_stamps": w(one, f"SELECT row_number() OVER (ORDER BY ds) - 1 AS pos, {SQL_DAY}, round(y, 4) AS y FROM daily"),
        "single_series_gap_runs": w(one_trim, "SELECT * FROM runs"),
        **{f"single_series_{x}": w(one_trim, f"SELECT pos, {SQL_DAY}, round({v}, 5) AS y, y IS NULL AS filled FROM around") for x, v in value.items()},
        "single_series_audit": w(one_trim, "SELECT count(*) AS n_periods, count(y) AS n_observed, count(*) - count(y) AS n_filled, 0 AS n_missing, (SELECT count(*) FROM runs) AS gaps, (SELECT max(length) FROM runs) AS longest_gap, max(trimmed) AS trimmed, 'ffill' AS strategy, CASE WHEN (SELECT max(length) FROM runs) >= greatest(3, floor(count(*) * 0.1)) THEN 'long gap' END AS warning FROM trimmed"),
        "single_series_backtest": w(one_trim + folds, f"SELECT fold, CASE WHEN origin % 2 = 1 THEN {H} ELSE 0 END AS n_scored, CASE WHEN origin % 2 = 1 THEN round((SELECT avg(abs(coalesce(a.y, a.y0) - (SELECT avg(coalesce(b.y, b.y0)) FROM around b WHERE b.pos BETWEEN o.origin - 7 AND o.origin - 1))) FROM around a WHERE a.pos BETWEEN o.origin AND o.origin + {H - 1}), 2) END AS mae, CASE WHEN origin % 2 = 0 THEN 'ValueError: ' || origin || ' days' END AS note FROM origins o"),
        "run_forecast_log": w(GATED, f"""SELECT 'axis' AS stage, 'chosen' AS action, NULL AS reason, '{{"column":"day"}}' AS data, 'ok' AS status
            UNION ALL SELECT 'series', 'validated', NULL, '{{"series":' || count(*) || ',"errors":0,"short":0}}', 'ok' FROM obs
            UNION ALL SELECT 'gaps', 'ffill', NULL, '{{"filled":' || {count('y IS NULL')} || ',"missing":0,"trimmed":' || (SELECT sum(t) FROM (SELECT max(trimmed) AS t FROM trimmed GROUP BY {key})) || '}}', 'ok' FROM trimmed
            UNION ALL SELECT 'backtest', 'seasonal_naive', NULL, '{{"folds":' || count(*) || '}}', 'ok' FROM origins
            UNION ALL SELECT 'gate', 'judged', CASE WHEN {count('NOT passed')} > 0 THEN 'some forecasts are rejected' END, '{{"passed":' || {count('passed')} || ',"rejected":' || {count('NOT passed')} || '}}', CASE WHEN {count('NOT passed')} > 0 THEN 'warn' ELSE 'ok' END FROM gated"""),
    }
    return {
        "detect_time_columns": "WITH o AS (SELECT *, CASE WHEN o_orderkey % 40 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS as_text FROM orders), r AS (SELECT avg(CASE WHEN try_strptime(as_text, '%d/%m/%Y') IS NOT NULL THEN 1.0 ELSE 0 END) AS rate, count(*) = count(DISTINCT o_orderkey) AS uniq FROM o) SELECT * FROM (SELECT 'o_orderdate' AS name, 'datetime' AS kind, 1.0::DOUBLE AS parse_rate, 1 AS rank UNION ALL SELECT 'iso', 'parsed', 1.0, 2 UNION ALL SELECT 'as_text', 'parsed', round(rate, 2), 3 FROM r WHERE rate >= 0.95 UNION ALL SELECT 'o_orderkey', 'ordered_int', 1.0, CASE WHEN rate >= 0.95 THEN 4 ELSE 3 END FROM r WHERE uniq)",
        "series_regularity": w(X.DAILY + ", points AS (SELECT DISTINCT o_orderpriority, day AS ds FROM daily), " + REGULARITY, f"SELECT {key}, count(*) AS n_stamps, round(CASE WHEN count(*) >= 3 THEN 1 - least(1.0::DOUBLE, stddev_pop(gap) / (avg(gap) + 1e-9)) ELSE 0 END, 4) AS regularity, CASE WHEN count(*) >= 3 THEN CASE WHEN quantile_cont(gap, 0.5) <= 43200 THEN 'H' WHEN quantile_cont(gap, 0.5) <= 129600 THEN 'D' WHEN quantile_cont(gap, 0.5) <= 691200 THEN 'W' WHEN quantile_cont(gap, 0.5) <= 3888000 THEN 'M' WHEN quantile_cont(gap, 0.5) <= 11664000 THEN 'Q' ELSE 'Y' END END AS freq FROM gaps GROUP BY 1"),
        "validate_series_input": "SELECT o_custkey, count(o_totalprice) AS n_observed, CASE WHEN count(o_totalprice) < 3 THEN 'error' ELSE 'ok' END AS status, CASE WHEN count(o_totalprice) < 3 THEN 'fewer than 3 observed points' END AS error FROM orders GROUP BY 1",
        "collapse_duplicates": f"SELECT {key}, strftime(o_orderdate, '%Y-%m-%d') AS ds, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1, 2",
        "regularize": w(X.GRID, f"SELECT {key}, pos, {SQL_DAY}, round(y, 4) AS y FROM grid"),
        "regularize_monthly_buckets": "WITH points AS (SELECT o_orderpriority, o_orderdate AS d, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2), m AS (SELECT o_orderpriority, date_trunc('month', d) AS ds, avg(y) AS y FROM points GROUP BY 1, 2), s AS (SELECT o_orderpriority, unnest(generate_series(CAST(min(ds) AS TIMESTAMP), CAST(max(ds) AS TIMESTAMP), INTERVAL 1 MONTH)) AS ds FROM m GROUP BY 1) SELECT s.o_orderpriority, row_number() OVER (PARTITION BY s.o_orderpriority ORDER BY s.ds) - 1 AS pos, strftime(s.ds, '%Y-%m-%d') AS ds, round(y, 4) AS y FROM s LEFT JOIN m ON s.o_orderpriority = m.o_orderpriority AND s.ds = m.ds",
        "integer_series": w(X.PROFILED, "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS ds, price AS y FROM prof WHERE price IS NOT NULL"),
        "default_horizon": w(X.FILLED, f"SELECT {key}, count(y) AS n_observed, CAST(greatest(1, floor(count(y) * 0.1::DOUBLE)) AS INT) AS h FROM filled GROUP BY 1"),
        "trim_edges": w(X.TRIM, f"SELECT {key}, pos, {SQL_DAY}, round(y, 4) AS y FROM trimmed"),
        "gap_runs": w(X.TRIM, f'SELECT {key}, min(pos) AS start, max(pos) AS "end", count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY {key} ORDER BY pos) AS island FROM trimmed WHERE y IS NULL) GROUP BY {key}, island'),
        **filled,
        "gap_audit": w(X.FILLED + ", runs AS (SELECT o_orderpriority, count(*) AS gaps, max(length) AS longest FROM (SELECT o_orderpriority, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY o_orderpriority ORDER BY pos) AS island FROM trimmed WHERE y IS NULL) GROUP BY o_orderpriority, island) GROUP BY 1)", "SELECT t.o_orderpriority, n_periods, n_observed, n_periods - n_observed AS n_filled, 0 AS n_missing, coalesce(gaps, 0) AS gaps, coalesce(longest, 0) AS longest_gap, trimmed, CASE WHEN coalesce(gaps, 0) = 0 THEN 'none' ELSE 'ffill' END AS strategy, CASE WHEN coalesce(longest, 0) > 0 AND longest >= greatest(3, floor(n_periods * 0.1)) THEN 'long gap' END AS warning FROM (SELECT o_orderpriority, count(*) AS n_periods, count(y) AS n_observed, max(trimmed) AS trimmed FROM trimmed GROUP BY 1) t LEFT JOIN runs r ON t.o_orderpriority = r.o_orderpriority"),
        "future_index": w(X.FILLED, f"SELECT {key}, step, strftime(last_ds + step * INTERVAL 1 DAY, '%Y-%m-%d') AS ds FROM (SELECT {key}, max(ds) AS last_ds, unnest(generate_series(1, {H})) AS step FROM filled GROUP BY 1)"),
        "naive": w(X.FILLED, f"SELECT {key}, unnest(generate_series(1, {H})) AS step, max_by(y, pos) AS yhat FROM filled GROUP BY 1"),
        "seasonal_naive": w(X.FILLED + POINT, f"SELECT {key}, step, yhat FROM pt"),
        "backtest_origins": w(ORIGINS, f"SELECT {key}, fold, origin FROM origins"),
        "backtest_naive": w(BASE, f"SELECT {key}, fold, step, pos, round(y, 4) AS y, round(yhat, 4) AS yhat FROM base"),
        "backtest_seasonal_naive": w(SEASON, f"SELECT {key}, fold, step, pos, round(y, 4) AS y, round(yhat, 4) AS yhat FROM season"),
        "backtest_metrics_by_fold": w(BASE, f"SELECT {key}, fold, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 2) AS mape, n_scored FROM (SELECT {key}, fold, {METRICS} FROM base GROUP BY 1, 2)".replace("count(DISTINCT fold) AS n_folds, ", "")),
        "backtest_metrics_pooled": w(BASE, f"SELECT {key}, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 2) AS mape, n_folds, n_scored FROM (SELECT {key}, {METRICS} FROM base GROUP BY 1)"),
        "residuals_by_step": w(COVER, f"SELECT {key}, fold, step, round(residual, 2) AS residual FROM res"),
        "compare_to_naive": w(COMPARE, f"SELECT {key}, round(model_mae, 2) AS model_mae, round(naive_mae, 2) AS naive_mae, beats_naive, improvement_pct FROM cmp"),
        "prediction_intervals": w(OFFSETS + POINT, f"SELECT pt.{key}, pt.step, round(yhat, 5) AS yhat, round(yhat + low, 5) AS lower, round(yhat + high, 5) AS upper FROM pt JOIN off ON pt.{key} = off.{key} AND pt.step = off.step"),
        "interval_coverage": w(COVER, f"SELECT {key}, round(coverage, 4) AS coverage FROM cov"),
        "forecast_gate": w(GATED, f"SELECT {key}, passed, reasons, warnings FROM gated"),
        "forecast_confidence": w(GATED, f"SELECT {key}, confidence, {LABEL} FROM gated"),
        "run_forecast_status": "SELECT o_custkey, CASE WHEN n < 3 THEN 'error' WHEN n - 2 <= greatest(2, n // 2) THEN 'no backtest' ELSE 'ok' END AS status, CASE WHEN n < 3 THEN 0 ELSE 2 END AS n_steps FROM (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, count(o_totalprice) AS n FROM orders GROUP BY 1)",
        **single,
        "run_forecast_naive": w(GATED + OFFSETS[len(COVER) :] + POINT, f"SELECT pt.{key}, pt.step, strftime(pt.ds, '%Y-%m-%d') AS ds, round(yhat, 5) AS yhat, round(yhat + low, 5) AS lower, round(yhat + high, 5) AS upper, passed, improvement_pct, {LABEL} FROM pt JOIN off ON pt.{key} = off.{key} AND pt.step = off.step JOIN gated g ON g.{key} = pt.{key}"),
    }
