"""Whole jobs: forecast of many series, tabular training and scoring, and the data-quality audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.functions.forecasters import SEASONS
from augury.operators import backtest as B
from augury.operators import series as S
from augury.sources.tables import event, events, written


def run_forecast(
    df: DataFrame, target: str, strategy: str, keys: list[str] | None = None, time_col: str | None = None, horizon: int | None = None, seasonal_period: int | None = None,
    frequency: str | None = None, level: float = 0.8, model: str = "auto", allow_compact: bool = False, max_periods: int = S.MAX_PERIODS,
) -> dict[str, DataFrame]:
    """Table to regular series, gaps, backtest against the naive baseline, forecast with bands, gate and confidence.

    Returns tables by series: status (every series of ``df``: ok, no backtest or error, and why), history, audit, folds, metrics,
    facts (one row a series that is not an error: gate, confidence, warnings), forecast (with the facts of its series) and log (what
    each stage did).  A null key is a series of its own.  What a failing model said is in the warnings of its series.  A series too short for a backtest has its forecast without bands, and does not pass the gate.  Each series has its own
    frequency unless one is given.  ``model`` is ``naive``, ``seasonal_naive`` or a registered forecaster.  Series with missing
    values after filling are refused by learned models unless ``allow_compact`` drops those periods.  A ``time_col`` that is no
    axis gives way to the best candidate, which the warnings say.
    """
    keys = keys or []
    asked, stamp = time_col, None
    if time_col in df.columns:
        stamp = S.stamps_of(df, time_col)
    if stamp is None:
        found = S.detect_time_columns(df, target).orderBy("rank").first()
        if found is None:
            raise ValueError("no column can be a time axis")
        time_col = found["name"]
        stamp = S.stamps_of(df, time_col)
    note = f"{asked} is no time axis; {time_col} is used" if asked not in (None, time_col) else None
    chosen, time_col = time_col, time_col.replace(".", "_")
    df = df.withColumn(time_col, stamp)
    status = S.validate_series(df, target, time_col, keys)
    good = status.where("status = 'ok'")
    rows = B._on(df, good.select(*keys), keys, how="left_semi") if keys else df.where(F.lit(good.count() > 0))
    options = (target, strategy, keys, time_col, horizon, seasonal_period, level, model, allow_compact)
    if isinstance(df.schema[time_col].dataType, T.IntegralType):
        series = S.integer_series(rows, keys, time_col, target)
        parts = [(_forecast(series, None, *options), None)]
    else:
        points = S.collapse_duplicates(rows, keys, time_col, target)
        freqs = S.frequency(rows, time_col, keys).select(*keys, (F.lit(frequency) if frequency else F.coalesce("freq", F.lit("D"))).alias("_freq"))
        # As many passes as there are frequencies, of which there are six.
        codes = [frequency] if frequency else sorted(r[0] for r in freqs.select("_freq").distinct().collect()) or ["D"]
        parts = []
        for code in codes:
            own = points if frequency else B._on(points, freqs.where(F.col("_freq") == code).drop("_freq"), keys, how="left_semi") if keys else points
            parts.append((_forecast(S.regularize(own, keys, code, max_periods=max_periods), code, *options), S.runaway_series(own, keys, code, max_periods)))
    out = {name: reduce(DataFrame.unionByName, [p[0][name] for p in parts]) for name in parts[0][0]}
    if note:
        out["facts"] = out["facts"].withColumn("warnings", F.array_append("warnings", F.lit(note)))
    runaway = [p[1] for p in parts if p[1] is not None]
    out["status"] = _final_status(status, out["facts"], reduce(DataFrame.union, runaway) if runaway else None, keys)
    out["log"] = _forecast_log(out, chosen, note, strategy, model)
    return out


def _forecast_log(out: dict[str, DataFrame], time_col: str, note: str | None, strategy: str, model: str) -> DataFrame:
    """One event for each stage of the job, with its counts."""
    n, count = F.count(F.lit(1)), F.count_if
    zero = lambda x: F.coalesce(x, F.lit(0))
    bad, rejected = F.col("errors") > 0, F.col("rejected") > 0
    status = out["status"].agg(n.alias("series"), count(F.col("status") == "error").alias("errors"), count(F.col("status") == "no backtest").alias("short"))
    gaps = out["audit"].agg(zero(F.sum("n_filled")).alias("filled"), zero(F.sum("n_missing")).alias("missing"), zero(F.sum("trimmed")).alias("trimmed"))
    facts = out["facts"].agg(zero(F.sum("n_folds")).alias("folds"), count("passed").alias("passed"), count(~F.col("passed")).alias("rejected"))
    c = lambda *names: {x: F.col(x) for x in names}
    return reduce(DataFrame.unionByName, [
        event(status.sparkSession.range(1), "axis", "chosen", {"column": F.lit(time_col)}, note, "warn" if note else "ok"),
        event(status, "series", "validated", c("series", "errors", "short"), F.when(bad, F.lit("some series cannot be forecast")), F.when(bad, "warn").otherwise("ok")),
        event(gaps, "gaps", strategy, c("filled", "missing", "trimmed")),
        event(facts, "backtest", model, c("folds")),
        event(facts, "gate", "judged", c("passed", "rejected"), F.when(rejected, F.lit("some forecasts are rejected")), F.when(rejected, "warn").otherwise("ok")),
    ])


def _final_status(status: DataFrame, facts: DataFrame, runaway: DataFrame | None, keys: list[str]) -> DataFrame:
    """The status of each series once forecasts were tried: too long a grid is an error, too short a history no backtest."""
    seen = B._on(status, facts.select(*keys, (F.col("n_folds") == 0).alias("_short"), "n", "h"), keys, how="left")
    long = F.lit(False)
    if runaway is not None:
        seen = B._on(seen, runaway.distinct().withColumn("_long", F.lit(True)), keys, how="left")
        long = F.coalesce("_long", F.lit(False))
    need = F.greatest(F.col("h"), F.floor(F.col("n") / 2)) + F.col("h")
    short = F.concat(F.lit("too short for a backtest: more than "), need.cast("string"), F.lit(" periods are needed"))
    ok = F.col("status") == "ok"
    return seen.select(
        *keys, "n_observed", F.when(ok & long, "error").when(ok & F.col("_short"), "no backtest").otherwise(F.col("status")).alias("status"),
        F.when(ok & long, "too many periods for its frequency").when(ok & F.col("_short"), short).otherwise(F.col("error")).alias("error"),
    )


def _forecast(series: DataFrame, freq: str | None, target: str, strategy: str, keys: list[str], time_col: str, horizon: int | None, seasonal_period: int | None, level: float, model: str, allow_compact: bool) -> dict[str, DataFrame]:
    """The tables of ``run_forecast`` for series of one frequency."""
    trimmed = written(S.trim_edges(series, keys), "trimmed")  # filling and the audit read it
    filled = S.fill_gaps(trimmed, keys, strategy)
    filled = written(filled, "filled")  # backtests, forecasts, stamps and the audit read it
    audit = S.gap_audit(trimmed, filled, keys, strategy)
    history = filled
    if allow_compact:
        history = S.integer_series(filled, keys, "pos", "y").withColumn("filled", F.lit(False))
    size = B.sizes(history, keys, horizon)
    origins = B.backtest_origins(size, keys)
    base, notes = written(B.backtest_baseline(history, keys, origins), "baseline"), None  # residuals, metrics, folds and bands read it
    if model in ("naive", "seasonal_naive"):
        period = seasonal_period or SEASONS.get(freq, 7) if model == "seasonal_naive" else None
        scored = base if period is None else written(B.backtest_baseline(history, keys, origins, period), "backtest")
        h = F.greatest(F.lit(1), F.col("h"))
        at = F.col("n") - 1 if period is None else F.when(F.col("n") < period, F.col("n") - 1).otherwise(F.col("n") - period + (F.col("step") - 1) % period)
        steps = size.select(*keys, "n", F.explode(F.sequence(F.lit(1), h)).alias("step")).withColumn("pos", at)
        point = B._on(steps, history.select(*keys, "pos", F.col("y").alias("yhat")), keys, ("pos",)).select(*keys, "step", "yhat")
    else:
        name = f"auto:{freq}" if model == "auto" else model
        tried = written(B.backtest_model(history, keys, origins, name), "backtest")
        scored = tried.where("yhat is not null and not isnan(yhat)").drop("note")
        point = written(B.model_forecast(history, keys, size, name), "forecast")
        notes = B.failure_notes(tried, point, keys)
        # A model that fails on a series leaves its naive forecast.
        last = history.groupBy(*keys).agg(F.max_by("y", "pos").alias("_last"))
        point = B._on(point, last, keys).withColumn("yhat", F.when(F.isnan("yhat") | F.col("yhat").isNull(), F.col("_last")).otherwise(F.col("yhat"))).drop("_last", "note")
    residuals = B.residuals_by_step(scored, keys)
    metrics, naive = B.backtest_metrics(scored, keys), B.backtest_metrics(base, keys)
    folds = base.groupBy(*keys).agg(F.count_distinct("fold").alias("n_folds"))
    facts = B._on(size.where("n > 0"), B.compare_to_naive(metrics, naive, keys), keys, how="left").withColumn("beats_naive", F.coalesce("beats_naive", F.lit(False)))
    facts = B._on(facts, folds, keys, how="left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0)))
    facts = B._on(facts, B.interval_coverage(residuals, keys, level), keys, how="left")
    facts = B.forecast_confidence(B.forecast_gate(facts, level), level)
    facts = B._on(facts, audit.select(*keys, "n_filled", "longest_gap", "trimmed", F.col("warning").alias("gap_warning")), keys, how="left")
    wide = F.when(F.col("h") > F.col("n_observed") / 3, "the horizon is over a third of the history")
    facts = facts.withColumn("warnings", F.array_compact(F.concat("warnings", F.array("gap_warning", wide)))).drop("gap_warning").withColumn("freq", F.lit(freq).cast("string"))
    if notes is not None:
        facts = B._on(facts, notes, keys, how="left").withColumn("warnings", F.concat("warnings", F.coalesce("notes", F.array().cast("array<string>")))).drop("notes")
    facts = written(facts, "facts")  # the forecast, its status and the log read it
    stamps = S.future_index(filled, keys, F.lit(horizon), freq) if horizon else _stamps(filled, keys, size, freq)
    bands = B.prediction_intervals(point, residuals, keys, size, level)
    forecast = B._on(bands, stamps, keys, ("step",))
    forecast = B._on(forecast, facts.select(*keys, "passed", "beats_naive", "improvement_pct", "confidence", "confidence_label"), keys)
    return {"history": filled, "audit": audit, "folds": B.backtest_metrics(scored, [*keys, "fold"]), "metrics": metrics, "facts": facts, "forecast": forecast, "residuals": residuals}


def _stamps(series: DataFrame, keys: list[str], size: DataFrame, freq: str | None) -> DataFrame:
    """Future stamps when each series has its own horizon: those up to the longest, cut by series."""
    longest = size.agg(F.max("h")).first()[0] or 1
    return B._on(S.future_index(series, keys, F.lit(longest), freq), size.select(*keys, "h"), keys).where("step <= h").drop("h")


def run_tabular(df: DataFrame, row_key: list[str], target: str | None = None, seed: int = 42, most_attempts: int = 3, families: list[str] | None = None, pattern: str | None = None) -> dict:
    """Coerce, profile, split, prepare, train until the gate passes, evaluate and explain; returns tables, among them log (what
    each stage did), and the model."""
    from augury.operators import evaluate as V
    from augury.operators import prep as C
    from augury.operators import profile as P
    from augury.operators import train as T

    plain = {c: c.replace(".", "_") for c in df.columns if "." in c}  # dots would be read as fields from here on
    df = df.toDF(*[plain.get(c, c) for c in df.columns])
    row_key, target = [plain.get(k, k) for k in row_key], plain.get(target, target)
    keyed = df.withColumns({k: df[k].cast("string") for k in row_key})
    # Many passes follow, each over a few columns, so the table is written once, by columns and with the split of a regression; memory
    # is left to the fits.
    rows = C.written_evenly(C.split(P.coerce_numeric_like(keyed, pattern=pattern or P.NUMBER_LIKE, keep=row_key), row_key, seed=seed), "table", row_key)
    table = rows.drop("is_train")
    inputs = table.drop(*row_key)
    asked = target is not None
    target = target or P.infer_target(inputs)
    counts = P.value_counts(inputs, apart=True)
    profile = {r["column"]: r for r in P.profile_columns(inputs, counts).collect()}  # a row for each column
    task = P.infer_task_type(inputs, target).first()["task"]
    if task == "classification":
        rows = C.split(table, row_key, seed=seed, stratify=target)
    prepared, fit = C.fit_preparation(rows, {c: r["role"] for c, r in profile.items()}, {c: r["cardinality"] for c, r in profile.items()}, target, task, row_key, of_files=task == "regression")
    got = T.train_until_gate(prepared, fit, row_key, most_attempts, seed=seed, families=families)
    metrics = T.tabular_metrics(prepared, fit, got.model)
    facts = metrics.withColumnRenamed("r2" if task == "regression" else "accuracy", "score").withColumns({"task": F.lit(task), "family": F.lit(got.family), "attempts": F.lit(got.attempts), "cv_mean": F.lit(got.cv_mean), "cv_std": F.lit(got.cv_std)})
    whole = P.overall_missing_pct(inputs).crossJoin(P.duplicate_rows(table, few=True)).crossJoin(inputs.agg(F.count(F.lit(1)).alias("n_rows")))  # one row each
    facts = V.tabular_confidence(V.tabular_gate(facts.crossJoin(whole))).withColumns({"n_cols": F.lit(len(inputs.columns)), "target": F.lit(target), "n_folds": F.lit(len(got.cv_scores))})  # one row each
    was = dict(keyed.dtypes)
    coerced = [c for c, kind in inputs.dtypes if was[c] == "string" and kind != "string"]
    log = _tabular_log(rows, prepared, facts, len(fit.features), coerced, asked)
    return {"profile": profile, "fit": fit, "prepared": prepared, "trained": got, "metrics": metrics, "facts": facts, "log": log}


def _tabular_log(rows: DataFrame, prepared: DataFrame, facts: DataFrame, n_features: int, coerced: list[str], asked: bool) -> DataFrame:
    """One event for each stage of the job, with its counts."""
    train, held = F.count_if("is_train"), F.count_if(~F.col("is_train"))
    parts = lambda df, name: df.agg(F.struct(train.alias("train"), held.alias("held_out")).alias(name))
    one = facts.crossJoin(parts(rows, "_split")).crossJoin(parts(prepared, "_kept"))  # one row each
    why = F.when(~F.col("passed"), F.array_join("reasons", "; "))
    c = lambda *names: {x: F.col(x) for x in names}
    of = lambda name: {x: F.col(f"{name}.{x}") for x in ("train", "held_out")}
    return events(one, [
        ("input", "read", c("n_rows", "n_cols")),
        ("coercion", "text to numbers", {"columns": F.array(*[F.lit(x) for x in coerced]).cast("array<string>")}),
        ("target", "given" if asked else "inferred", c("target", "task")),
        ("split", "by hash of the key", of("_split")),
        ("preparation", "fitted on training rows", of("_kept")),
        ("training", F.col("family"), {"features": F.lit(n_features)} | c("attempts", "n_folds", "cv_mean", "cv_std")),
        ("gate", "judged", c("score", "passed", "confidence"), why, F.when(F.col("passed"), "ok").otherwise("warn")),
    ])


def explanation_report(facts: DataFrame, importance: DataFrame) -> DataFrame:
    """One row of JSON: dataset, model, metrics, stability, top drivers, gate, confidence and what to do; all read, none recomputed."""
    drivers = importance.orderBy("rank").limit(5).agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "importance"))).alias("drivers"))
    advice = F.when(F.col("passed"), "The model may be used; check its drivers from time to time.").otherwise("Do not use the model; more or better data is needed.")
    return facts.crossJoin(drivers).select(F.to_json(F.struct(*[c for c in ("n_rows", "n_cols", "target") if c in facts.columns], "task", "family", "score", *[c for c in ("mae", "f1_weighted") if c in facts.columns], "cv_mean", "cv_std", *[c for c in ("n_folds",) if c in facts.columns], "drivers", "passed", "reasons", "confidence", "confidence_label", advice.alias("recommendation"))).alias("report"))  # one row each


def coercion_impact(df: DataFrame, row_key: list[str], target: str, **options) -> DataFrame:
    """Score under the wide and the strict number pattern, side by side; patterns that turn the same columns into numbers make
    the same table, so one run is the run of both."""
    from augury.operators import profile as P

    runs, out = {}, []
    for name, p in (("number_like", P.NUMBER_LIKE), ("units_only", P.UNITS_ONLY)):
        chosen = tuple(P.numeric_like(df, pattern=p, keep=row_key))
        if chosen not in runs:
            runs[chosen] = run_tabular(df, row_key, target, pattern=p, **options)["facts"].select("family", "score", "cv_mean", "passed")
        out.append(runs[chosen].select(F.lit(name).alias("pattern"), "*"))
    return out[0].unionByName(out[1])


def quality_audit(df: DataFrame) -> dict[str, DataFrame]:
    """Coercion audit, then profile, warnings and duplicates of the coerced table."""
    from augury.operators import profile as P

    coerced = P.coerce_numeric_like(df)
    return {"coercion": P.coercion_audit(df), "profile": P.profile_columns(coerced), "warnings": P.profile_warnings(coerced), "samples": P.sample_values(coerced)}
